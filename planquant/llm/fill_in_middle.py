"""Fill-in-middle transformation: DuckDB cuts and reorders the texts of each Arrow batch.

A text is a list of tokens (white space in front of a word belongs to it; white space at the end is a token). Four numbers from the
sha256 of `seed:doc_id` choose two cuts between tokens and the form: plain, psm (prefix, suffix, middle) or spm (suffix, prefix,
middle). The forms carry sentinels, so `restored` gives back the exact text.

The work is one SQL statement over a registered Arrow batch of about 1 MB of text (a longer text is a batch of its own); no
row passes through Python. The database lives in the worker's memory for one task and may not write to disk.

Null and empty texts are plain, with 0 tokens and an empty output; so is a text that holds a sentinel. A null id is an empty one
in the digest. Repeated rows give repeated results, and an empty table gives none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from planquant.llm.common import arrow_map, slices

SEED = 42
#: In hundredths: texts that are reordered, and those of them in the order suffix, prefix, middle.
SHARE, SPM_SHARE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that a statement works on. Its lists of tokens take about 30 times that (a single text of 34 MB: 1.1 GB).
STATEMENT_BYTES = 1 << 20

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def statement(seed: int, share: int, spm_share: int) -> str:
    """SQL from batch(doc_id, text) to the operator's columns."""
    number = lambda k: f"cast('0x' || substr(h, {8 * k - 7}, 8) as bigint) as h{k}"
    holds = " or ".join(f"contains(text, '{x}')" for x in (PREFIX, SUFFIX, MIDDLE))
    return f"""
        with texts as (
            select doc_id, coalesce(text, '') as text, sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')) as h from batch
        ), cut as (
            select doc_id, text, regexp_extract_all(text, '{TOKEN}') as tokens, {", ".join(map(number, range(1, 5)))} from texts
        ), chosen as (
            select doc_id, text, tokens, len(tokens) as n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                   case when text = '' or {holds} or h3 % 100 >= {share} then 'plain' when h4 % 100 < {spm_share} then 'spm' else 'psm' end as form
            from cut
        ), parts as (
            select doc_id, text, n, form,
                   case when form <> 'plain' then array_to_string(list_slice(tokens, 1, a), '') end as head,
                   case when form <> 'plain' then array_to_string(list_slice(tokens, a + 1, b), '') end as mid,
                   case when form <> 'plain' then array_to_string(list_slice(tokens, b + 1, n), '') end as tail
            from chosen
        )
        select doc_id, cast(n as bigint) as n, form, cast(length(head) as bigint) as prefix_chars, cast(length(mid) as bigint) as middle_chars,
               case form when 'plain' then text
                         when 'psm' then '{PREFIX}' || head || '{SUFFIX}' || tail || '{MIDDLE}' || mid
                         else '{SUFFIX}' || tail || '{PREFIX}' || head || '{MIDDLE}' || mid end as output
        from parts
    """


def fill_in_middle(docs: DataFrame, seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output, the text in its form, of every row."""
    sql = statement(seed, share, spm_share)
    kind = docs.select(id_col).dtypes[0][1]

    def run(batches):
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as db:
            for batch in batches:
                for part in slices(batch, most=STATEMENT_BYTES):
                    db.register("batch", pa.Table.from_batches([part]).rename_columns(["doc_id", "text"]))
                    yield from db.sql(sql).to_arrow_table().cast(pa.schema([part.schema.field(0).with_name("doc_id"), *_COLUMNS])).to_batches()
                    db.unregister("batch")

    return arrow_map(docs.select(id_col, text_col), run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


_COLUMNS = [pa.field("n", pa.int64()), pa.field("form", pa.string()), pa.field("prefix_chars", pa.int64()), pa.field("middle_chars", pa.int64()), pa.field("output", pa.string())]


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output of a form was made from. A sentinel's first place is its own: no text that was reordered holds one,
    and none begins before another ends."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    last = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
