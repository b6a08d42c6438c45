"""Token counts: lengths only, from batched encoding of safely split texts.

A text is split at ASCII white space. The tokenizer drops white space, composes (NFC) and lower-cases within
words only, so a text's count is the sum over its pieces, however long the text. A piece that is a word with marks
behind it is split between the two. Each slice of an Arrow batch (balanced by bytes) encodes what it hasn't met in one
call of the library; counts already met are kept in the worker, up to `CACHE` of them beside the slice's own.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planquant.llm.common import Kept, arrow_map, slices

#: Pieces, and units of pieces, whose counts a worker keeps; pieces met later are encoded slice by slice.
CACHE = 500_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, Kept("token_counts", CACHE), Kept("token_counts", CACHE)


#: A run of letters of the first two Unicode blocks, then ASCII marks without an apostrophe: two units of the
#: tokenizer's pattern, whatever stands around them.
_SIMPLE = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def count_tokens(texts: list[bytes], path: str) -> list[int]:
    """Token counts of UTF-8 texts."""
    tokenizer, kept, units = _tokenizer(path)
    words = [t.split() for t in texts]
    own = set().union(*words)
    new = own.difference(kept)
    parts = {p: m.groups() if (m := _SIMPLE.fullmatch(s := p.decode())) else (s,) for p in new}
    todo = list({u for g in parts.values() for u in g if u and u not in units})
    fresh = dict(zip(todo, map(len, tokenizer.encode_batch_fast(todo, add_special_tokens=False)), strict=True))
    size = lambda u: units[u] if u in units else fresh[u]
    found = {p: sum(size(u) for u in g if u) for p, g in parts.items()}
    if len(units) + len(fresh) <= CACHE:
        units.update(fresh)
    known = kept
    if len(kept) + len(found) <= CACHE:
        kept.update(found)
    else:
        known = {p: kept[p] for p in own.difference(found)} | found
    get = known.__getitem__
    return [sum(map(get, w)) for w in words]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""

    def run(batches):
        Kept.mine("token_counts")
        for batch in batches:
            for part in slices(batch):
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                n = np.array(count_tokens(texts, tokenizer_path), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.select(id_col).dtypes[0][1]
    return arrow_map(docs.select(id_col, text_col), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
