"""Line dedup: content-defined chunks of lines, repeated ones removed after byte comparison. DataFrame functions only.

A text is cut at line feeds; lines without a word are passed over. A rolling hash goes over the line hashes, in a window that
is measured in words: from every line on, forwards and backwards, it takes in lines until they have more than
`over_words` words. Where it is 0 modulo `modulus` the window's edges are boundaries and the window is a chunk, so
boundaries depend on nothing but the chunk's own lines, whatever stands around them. With the default modulus, 1, a passage of over
`over_words` words in whole lines is covered by its chunks from its first to its last line; any larger one leaves
passages of two or three lines without a chunk inside (README: recall by modulus).

Of each key that occurs twice or more the first place (by doc_id, then a hash of the text, then position) stays. Its bytes are
taken from its text and sent to the other places, and their lines go where their own bytes are equal. All places of a key
meet its bytes in one plain equi-join of two shuffled tables, which Spark splits where a key is hot; counts and first
places are found with map-side combining.

Null texts stay null, empty ones empty. Rows that repeat both id and text are one document: all keep the same lines.
Null ids come first. Texts of any length are read whole: a chunk has at most `over_words` + 1 lines. Columns of docs that are
called n_lines or n_removed are left out in favour of the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planquant.llm.common import compact, parts_for, shared_table

OVER_WORDS = 50

_WORDS = r"[^\\x20\\x09-\\x0D]+"


def _lines(text: str) -> Column:
    """The lines that have words: (at: index in the text, h: hash, w: words)."""
    return F.expr(f"filter(transform(split({text}, '\\n'), (l, i) -> struct(i as at, xxhash64(l) as h, regexp_count(l, '{_WORDS}') as w)), x -> x.w > 0)")


def _chunks(over: int, modulus: int) -> Column:
    """Of the lines in column a: (key, first, last) of each chunk; first and last are lines of the text."""
    step = f"(s, x) -> if(s.w > {over}, s, named_struct('w', s.w + x.w, 'n', s.n + 1))"

    def grown(of: str) -> str:
        return f"aggregate({of}, named_struct('w', 0, 'n', 0), {step})"

    def lines(short: str, full: str) -> str:
        """How many lines bring a window over the limit; null if the text ends before."""
        return f"transform(array(if({grown(short)}.w > {over}, {grown(short)}, {grown(full)})), s -> if(s.w > {over}, s.n, null))[0]"

    ahead = lines("slice(a, i + 1, 4)", f"slice(a, i + 1, {over + 1})")
    back = lines("reverse(slice(a, greatest(i - 2, 1), least(4, i + 1)))", f"reverse(slice(a, greatest(i + 1 - {over}, 1), least({over + 1}, i + 1)))")
    # A window is one number, i * m + n: distinct numbers are found by hashing, distinct structs by comparing all pairs.
    m = over + 2
    windows = f"array_distinct(concat(transform(a, (x, i) -> i * {m} + {ahead}), transform(a, (x, i) -> transform(array({back}), n -> (i + 1 - n) * {m} + n)[0])))"
    each = f"transform(filter({windows}, v -> v is not null), v -> named_struct('i', cast(v div {m} as int), 'n', cast(v % {m} as int)))"
    keyed = f"transform({each}, c -> named_struct('key', xxhash64(transform(slice(a, c.i + 1, c.n), x -> x.h)), 'first', a[c.i].at, 'last', a[c.i + c.n - 1].at))"
    return F.expr(keyed if modulus == 1 else f"filter({keyed}, c -> pmod(c.key, {modulus}) = 0)")


def _places(docs: DataFrame, over_words: int, modulus: int, id_col: str, text_col: str) -> DataFrame:
    """(key, id, hash, first, last) of every chunk."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    lines = given.select("id", F.xxhash64("text").alias("hash"), _lines("text").alias("a"))
    return lines.select("id", "hash", F.explode(_chunks(over_words, modulus)).alias("c")).select("c.key", "id", "hash", "c.first", "c.last")


#: A chunk's bytes: the lines from c.first to c.last that have words.
_BODY = f"array_join(filter(slice(lines, c.first + 1, c.last - c.first + 1), l -> l rlike '{_WORDS}'), '\\n')"


def _row(id_col: str, hash_col: str) -> Column:
    """One value for the rows that are one document."""
    return F.concat(F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")), F.lit(":"), F.hex(hash_col))


def dedup_lines(docs: DataFrame, over_words: int = OVER_WORDS, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, modulus: int = 1) -> DataFrame:
    """The columns of docs (or those named), text without repeated chunks, and n_lines and n_removed."""
    columns = [c for c in (columns if columns is not None else docs.columns) if c not in ("n_lines", "n_removed")]
    others = [c for c in columns if c not in (id_col, text_col)]
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"), *([F.struct(*others).alias("rest")] if others else []))
    # Both uses of the texts below read this one shuffle: in an array no column of a use can be left out of its own.
    texts = given.select(_row("id", "hash").alias("row"), F.array(F.struct("id", "text", *(["rest"] if others else []))).alias("given"))
    of = lambda c: F.col("given")[0][c].alias(c)

    parts = parts_for(docs)
    places = shared_table(_places(compact(docs, parts), over_words, modulus, id_col, text_col), "chunks")
    kept = places.groupBy("key").agg(F.min(F.struct("id", "hash", "first", "last")).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")

    # The bytes of each kept chunk, from its own text; rows that repeat a text give them once.
    of_text = kept.select(_row("kept.id", "kept.hash").alias("row"), "key", "kept.*").groupBy("row").agg(F.collect_list(F.struct("key", "id", "hash", "first", "last")).alias("chunks"))
    one = texts.join(of_text, "row").groupBy("row").agg(F.any_value("given").alias("given"), F.any_value("chunks").alias("chunks"))
    # The bodies are made before the chunks become rows, from lines that are split once: rows of chunks must not carry whole texts.
    bodied = F.expr(f"transform(array(split(given[0].text, '\\n')), lines -> transform(chunks, c -> struct(c.key as of_key, struct(c.id, c.hash, c.first) as kept, {_BODY} as body)))[0]")
    bodies = one.select(F.explode(bodied).alias("b")).select("b.*")

    # Every other place of the chunk, held against those bytes where its own text is.
    more = places.join(bodies, F.col("key") == F.col("of_key")).filter(~F.struct("id", "hash", "first").eqNullSafe(F.col("kept")))
    claims = more.select(_row("id", "hash").alias("row"), F.struct("first", "last", "body").alias("claim")).groupBy("row").agg(F.collect_set("claim").alias("claims"))
    joined = texts.join(claims, "row", "left").select(of("id"), of("text"), *([of("rest")] if others else []), "claims", F.split(of("text"), "\n").alias("lines"))
    true = F.expr(f"filter(claims, c -> c.body = {_BODY})")
    gone = F.expr("array_distinct(flatten(transform(true_claims, c -> sequence(c.first, c.last))))")
    left = F.expr("if(size(gone) > 0, array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\\n'), text)")
    cleaned = joined.withColumn("true_claims", true).withColumn("gone", gone)
    taken = {id_col: F.col("id"), text_col: F.when(F.col("claims").isNull(), F.col("text")).otherwise(left)}
    return compact(cleaned, parts).select(
        *[taken[c].alias(c) if c in taken else F.col("rest").getField(c).alias(c) for c in columns],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
