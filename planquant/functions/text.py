"""Column functions over plan text: matching with positions and groups, numbers, sizes, tokens, OCR cleanup.

All of them are compositions of built-in functions, so they stay in the JVM and inside whole-stage plans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from planquant.functions import rules
from planquant.functions.arrays import let, running

STOP_WORDS = ("the", "a", "an", "and", "or", "for", "to", "of", "in", "on", "at", "by", "with")
SYNONYMS = {
    "endwalls": "endwall", "pipes": "pipe", "inlets": "inlet", "manholes": "manhole", "culverts": "culvert",
    "rcp": "pipe", "hdpe": "pipe", "pvc": "pipe", "cmp": "pipe", "srcp": "pipe",
}


def strip(s: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(s, F.lit(" \t\n\x0b\f\r"))


def none_if_empty(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def extract(s: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    return none_if_empty(F.regexp_extract(s, pattern, group))


def rlike(s: Column, pattern: str) -> Column:
    return F.regexp_like(s, F.lit(pattern))


def contains_any(s: Column, words) -> Column:
    """Whether any of the words occurs anywhere."""
    return reduce(lambda a, b: a | b, [F.contains(s, F.lit(w)) for w in words])


def words_found(s: Column, words) -> Column:
    """The words that occur, in their given order. `s` is looked at once for each word: fold its case beforehand (`let`)."""
    return F.array_compact(F.array(*[F.when(F.contains(s, F.lit(w)), F.lit(w)) for w in words]))


def placed(found: Column, between: Column) -> Column:
    """Where each of the strings found starts, counted in characters from 0; `between` are those before, between and after them."""
    lengths = F.zip_with(F.transform(found, lambda m: F.length(m)), F.transform(F.slice(between, F.lit(1), F.size(found)), lambda g: F.length(g)), lambda m, g: m + g)
    ends = let(lengths, lambda n: running(n, 0, lambda a, b: a + b))
    return F.transform(F.slice(ends, F.lit(2), F.size(found)), lambda e, i: e - F.length(F.get(found, i)))


def matches(s: Column, pattern: str, groups: int, with_start: bool = False, short: bool = False) -> Column:
    """All matches, leftmost and non-overlapping, in order: struct(m, g1 .. gn[, start]); groups that took no part are null.

    The text is scanned once, and each match for its groups; a pattern that looks at what stands around a match is scanned
    for each group instead. start counts characters from 0; `short` is for strings of a few matches, which need no blocks."""
    group = lambda x, k: none_if_empty(x).alias(f"g{k}")
    numbers = range(1, groups + 1)
    looks_around = any(x in pattern for x in ("(?=", "(?!", "(?<"))

    def structs(found: Column, starts: Column | None) -> Column:
        if looks_around and groups:
            parts = F.arrays_zip(found.alias("m"), *[F.regexp_extract_all(s, F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in numbers])
            fields = lambda x: [x["m"].alias("m"), *[group(x[f"g{k}"], k) for k in numbers]]
        else:
            parts, fields = found, lambda x: [x.alias("m"), *[group(F.regexp_extract(x, pattern, k), k) for k in numbers]]
        if starts is None:
            return F.transform(parts, lambda x: F.struct(*fields(x)))
        return F.transform(parts, lambda x, i: F.struct(*fields(x), F.get(starts, i).alias("start")))

    found = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    if not with_start:
        return structs(found, None)
    between = F.split(s, pattern, -1)
    if short:
        total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda t, x: t + F.length(x))
        return let(found, lambda f: structs(f, F.transform(f, lambda _, i: total(between, i + 1) + total(f, i))))
    return let(found, lambda f: let(placed(f, between), lambda at: structs(f, at)))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def parse_number(s: Column) -> Column:
    """A number with thousands separators; 0.0 for anything else."""
    return F.coalesce(to_double(F.replace(s, F.lit(","), F.lit(""))), F.lit(0.0))


#: All that a cast reads as a double has this form.
_DOUBLE = r"(?i)^[\x00-\x20]*[-+]?(?:nan|inf(?:inity)?|0x[0-9a-f.]+p[-+]?\d+|(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?)[fd]?[\x00-\x20]*$"


def to_double(s: Column) -> Column:
    """A double, or null. Only what can be a number is cast: a cast of other text costs an exception for each value."""
    return F.when(rlike(s, _DOUBLE), s.try_cast("double"))


def parse_price(s: Column) -> Column:
    """A price with a currency sign and thousands separators; 0.0 for anything else."""
    return F.coalesce(to_double(F.regexp_replace(s, r"[$,]", "")), F.lit(0.0))


def size_key(s: Column) -> Column:
    """A size as a key: without quotes and blanks, in capitals."""
    return F.upper(F.regexp_replace(s, r"[\"' ]", ""))


def size_inches(s: Column) -> Column:
    """The first number of a size, with an inch sign; empty if there is none."""
    number = F.regexp_extract(F.coalesce(s, F.lit("")), r"(\d+(?:\.\d+)?)", 1)
    return F.when(number != "", F.concat(number, F.lit('"'))).otherwise("")


def code_key(s: Column) -> Column:
    """A pay item's code without white space at its ends, in capitals."""
    return F.upper(strip(F.coalesce(s, F.lit(""))))


def tokens(s: Column) -> Column:
    """Distinct words of two characters or more, without stop words, synonyms folded."""
    words = F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(r"\b[a-z0-9]+\b"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    same = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.array_distinct(F.transform(kept, lambda w: F.coalesce(F.element_at(same, w), w)))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.6, "medium").otherwise("low")


def needed_strings(pattern: str) -> list[str]:
    """Strings of which every match of a pattern has one: the longest run of characters, each given or one of a few, at its top level,
    or one of the words of a group of plain words. Empty if there is none."""
    from re import _constants as kinds, _parser

    def plain(value) -> list[str] | None:
        """The words of a group, if it has nothing else."""
        parts = list(value)
        if len(parts) == 1 and parts[0][0] is kinds.BRANCH:
            words = [plain(x) for x in parts[0][1][1]]
            return None if None in words else [w for some in words for w in some]
        return ["".join(chr(v) for _, v in parts)] if parts and all(k is kinds.LITERAL for k, _ in parts) else None

    def choices(kind, value) -> list[str] | None:
        if kind is kinds.LITERAL:
            return [chr(value)]
        if kind is kinds.IN and len(value) < 5 and all(k is kinds.LITERAL for k, _ in value):
            return [chr(v) for _, v in value]
        return None

    runs, run, words = [[]], [""], []
    for kind, value in _parser.parse(pattern):
        some = choices(kind, value)
        run = [a + b for a in run for b in some] if some else [""]
        runs.append(run)
        # sre takes the beginning that all words of a group share out of the branch; such groups are not looked into.
        words = words or (plain(value[3]) or [] if kind is kinds.SUBPATTERN else [])
    best = max(runs, key=lambda r: len(r[0]) if r else 0)
    return best if best and best[0] else words


def needed_clauses(pattern: str) -> list[list[str]]:
    """Lists of strings, in capitals: every match of a pattern, whatever its case, has one of each list. Runs of characters, each given or one of a
    few, through groups and words of a choice; of a choice of other things one of what each of these needs."""
    from re import _constants as kinds, _parser

    clauses: list[list[str]] = []
    run = [""]

    def end() -> None:
        nonlocal run
        if all(run) and run not in clauses:
            clauses.append(run)
        run = [""]

    def character(code: int) -> str | None:
        c = chr(code)
        return c.upper() if c.isascii() else c if c == c.upper() else None

    def grow(some: list[str | None]) -> None:
        nonlocal run
        if None in some or len(run) * len(some) > 16:
            end()
        if None not in some:
            run = list(dict.fromkeys(a + b for a in run for b in some))

    def plain(parts) -> str | None:
        cs = [character(v) if k is kinds.LITERAL else None for k, v in parts]
        return None if None in cs else "".join(cs)

    def walk(parts) -> None:
        nonlocal run
        for kind, value in parts:
            if kind is kinds.LITERAL:
                grow([character(value)])
            elif kind is kinds.IN and len(value) < 5 and all(k is kinds.LITERAL for k, _ in value):
                grow([character(v) for _, v in value])
            elif kind is kinds.SUBPATTERN:
                walk(value[3])
            elif kind is kinds.BRANCH:
                words = [plain(x) for x in value[1]]
                if all(words):
                    grow(words)
                else:
                    end()
                    best = [max(needed(x), key=lambda c: min(map(len, c)), default=None) for x in value[1]]
                    if None not in best:
                        clauses.append([w for c in best for w in c])
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] > 0:
                end()
                walk(value[2])
                end()
            elif kind is not kinds.AT:
                end()

    def needed(parts) -> list[list[str]]:
        nonlocal clauses, run
        outer, clauses, run = (clauses, run), [], [""]
        walk(parts)
        end()
        found, (clauses, run) = clauses, outer
        return found

    return sorted(needed(_parser.parse(pattern)), key=lambda c: -min(map(len, c)))


def may_match(up: Column, pattern: str) -> Column:
    """False only where a pattern, whatever its case, has no match in the text whose capitals are `up`."""
    return reduce(lambda a, b: a & b, [contains_any(up, words) for words in needed_clauses(pattern)], F.lit(True))


def clean_ocr(s: Column) -> Column:
    """Capitals, then every misreading rule in order, then the size rules. A few rules at a time are only run over a text that has
    the letters which every match of one of them has: where none can match first, none ever does."""
    fixes = (*rules.OCR_FIXES, *rules.SIZE_FIXES)

    def mended(out: Column, some) -> Column:
        needed = [needed_strings(p) for p, _ in some]
        changed = lambda x: reduce(lambda y, rule: F.regexp_replace(y, *rule), some, x)
        return let(out, lambda x: F.when(contains_any(x, dict.fromkeys(w for ws in needed for w in ws)), changed(x)).otherwise(x)) if all(needed) else changed(out)

    return reduce(mended, [fixes[k : k + 4] for k in range(0, len(fixes), 4)], F.upper(s))


def changed_characters(before: Column, after: Column) -> Column:
    """Positions, up to the shorter length, at which two texts differ."""
    n = F.least(F.length(before), F.length(after))
    a, b = F.split(F.left(before, n), ""), F.split(F.left(after, n), "")
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))


def sender_address(header: Column) -> Column:
    """The address of a mail header: in angle brackets, else bare, else the header itself; lower case."""
    return F.lower(F.coalesce(extract(header, r"<([^>]+)>"), extract(header, r"([\w.+-]+@[\w.-]+\.\w+)"), strip(header)))


def safe_filename(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\w\-.]", "_")


def project_of(filename: Column) -> Column:
    """The project a file belongs to: its stem up to _part, _page, _split or a number."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    return F.coalesce(extract(stem, r"^(.+?)(?:_part|_page|_split|_\d+)"), stem)


def is_round_size(n: Column) -> Column:
    return n.isin(*rules.PIPE_SIZES)


def is_elliptical_size(rise: Column, span: Column) -> Column:
    pairs = [f"{a}x{b}" for a, b in rules.ELLIPTICAL_SIZES]
    name = lambda a, b: F.concat(a.cast("string"), F.lit("x"), b.cast("string"))
    return name(rise, span).isin(*pairs) | name(span, rise).isin(*pairs)


def swap_size_quantity(size: Column, quantity: Column) -> Column:
    """struct(size, quantity), exchanged where only the quantity is a pipe size."""
    whole = F.when(quantity == F.floor(quantity), quantity.cast("long"))
    swap = F.coalesce(~is_round_size(size) & is_round_size(whole), F.lit(False))
    return F.when(swap, F.struct(whole.cast("int").alias("size"), size.cast("double").alias("quantity"))).otherwise(F.struct(size.cast("int").alias("size"), quantity.cast("double").alias("quantity")))


def is_membrane(s: Column, size: Column | None = None) -> Column:
    """Whether a text names a liner: a thickness in mil, a membrane word, or a code of such goods.

    FLEXIBLE, GEOTEXTILE, FABRIC, SHEET and WATERPROOFING alone count only with a liner's thickness as size."""
    up = F.upper(F.coalesce(s, F.lit("")))
    plain = rlike(up, r"\b\d+\s*MIL\b") | contains_any(up, ("MEMBRANE", "LINER")) | contains_any(up, rules.NON_PIPE_PREFIXES)
    return plain if size is None else plain | (contains_any(up, rules.MEMBRANE_WORDS) & F.coalesce(size.isin(*rules.MEMBRANE_MILS), F.lit(False)))


def first_present(s: Column, patterns, default: Column) -> Column:
    return F.coalesce(*[none_if_empty(strip(F.regexp_extract(s, p, 1))) for p in patterns], default)


# Where project facts stand.
PROJECT_NAME = (r"(?i)PROJECT[:\s]+(.+?)(?:\n|$)", r"(?i)PROJECT NAME[:\s]+(.+?)(?:\n|$)", r"(?i)TITLE[:\s]+(.+?)(?:\n|$)")
PROJECT_LOCATION = (r"(?i)(?:LOCATION|COUNTY)[:\s]+(.+?)(?:\n|$)", r"(?i)(.+?COUNTY),?\s*(?:FLORIDA|FL)")
PROJECT_OWNER = (r"(?i)(?:OWNER|CLIENT)[:\s]+(.+?)(?:\n|$)", r"(?i)(?:FOR|PREPARED FOR)[:\s]+(.+?)(?:\n|$)")
PROJECT_ENGINEER = (r"(?i)(?:ENGINEER|P\.?E\.?)[:\s]+(.+?)(?:\n|$)", r"(?i)PREPARED BY[:\s]+(.+?)(?:\n|$)")


def project_facts(text: Column, filename: Column) -> Column:
    """struct(name, location, owner, engineer) of a document; the name defaults to the file's."""
    given = F.replace(F.regexp_replace(filename, r"\.(pdf|PDF)", ""), F.lit("_"), F.lit(" "))
    blank = F.lit("")
    return F.struct(
        first_present(text, PROJECT_NAME, given).alias("name"),
        first_present(text, PROJECT_LOCATION, blank).alias("location"),
        first_present(text, PROJECT_OWNER, blank).alias("owner"),
        first_present(text, PROJECT_ENGINEER, blank).alias("engineer"),
    )
