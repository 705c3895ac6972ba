"""Byte-level BPE with the tiktoken library: rank file, safe cuts of long texts, decoding of raw bytes."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, extended

LONG = 1 << 16  # characters after which a text is cut
# White space after a letter or digit always starts a new match of the pattern, and no match looks back, so what
# follows is matched as in the whole text; the part before it ends in a character that looks at nothing.
SAFE = regex.compile(r"(?<=[A-Za-z0-9])[ \n]")
# A run of white space is one match but for its last character, which goes with what follows.  The library's regex
# engine recurses on such runs and overflows its stack, so long ones are cut out and merged as the one match they are.
BLANK = regex.compile(r"\p{White_Space}{1000,}+")


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = LONG) -> list[str]:
    """Cut a text at safe boundaries into pieces of at least ``size`` characters; without a boundary it stays whole."""
    out, i = [], 0
    while len(text) - i > size:
        cut = SAFE.search(text, i + size)
        if cut is None:
            break
        out.append(text[i : cut.start()])
        i = cut.start()
    out.append(text[i:])
    return out


def encode(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text, the same as of the whole text at once."""
    if len(text) < 1000:
        return np.array(enc.encode_ordinary(text), "<u4")
    out, i = [], 0
    for run in BLANK.finditer(text):
        stop = run.end() - (run.end() < len(text))
        out += [enc.encode_ordinary(p) for p in pieces(text[i : run.start()])]
        out.append(enc._encode_single_piece(text[run.start() : stop]))
        i = stop
    out += [enc.encode_ordinary(p) for p in pieces(text[i:])]
    return np.concatenate([np.array(x, "<u4") for x in out])


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers in one binary).

    Every match of ``pattern`` is merged separately and no special token is known.  Null and empty texts have no ids.
    """

    def start():
        enc = encoding(path, pattern)

        def work(texts):
            ids = [encode(enc, t or "") for t in texts.to_pylist()]
            return [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]

        return work

    return added(df, text, keep, "n_tokens long, ids binary", start)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the raw bytes of the ids (not always valid UTF-8); null for null."""
    kept = [c for c in df.columns if c.lower() != "decoded"]
    at = kept.index(ids)
    rows = df.select(*[df[f"`{c}`"] for c in kept])

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            out = [None if x is None else enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return rows.mapInArrow(run, extended(rows.schema, "decoded binary"))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    from .common import documents

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ids = encode_texts(documents(spark, sf_dir), path, public.PATTERN, keep=["doc_id"])
    return decode_ids(ids, path, public.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
