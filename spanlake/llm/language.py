"""Language identification by compression.

Each language has a raw-content dictionary of zstandard: normalised text of a bounded sample of its documents, of each at
most PER_DOCUMENT bytes. A text is normalised in the same way (letters and their marks in lower case, one space between
words), cut into pieces of PIECE bytes, and each piece is encoded with every language's dictionary. The language with the
smallest total wins. Where the margin to the second is narrow, ``rejected`` is true; the best guess stays in lang_pred.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any learned language all texts are;
ties go to the language with more labelled documents; rows of equal id are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X
from .common import documents, remainder

#: The sample: documents a language, bytes of a dictionary, and bytes that one document gives at most.
DOCS, DICTIONARY, PER_DOCUMENT = 150, 96 << 10, 12 << 10
PIECE, LEVEL = 4096, 6
#: Margins below this many bits a byte are rejected.
MARGIN = 0.05

_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def normalise(text: str | None) -> bytes:
    """Runs of letters and marks in lower case, separated by single spaces; nothing where there is no letter."""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace") if text and _LETTER.search(text) else b""


def dictionaries(docs: DataFrame, learn: Column, per_language: int = DOCS, size: int = DICTIONARY) -> dict[str, bytes]:
    """The dictionary of each language from about ``per_language`` of its documents, chosen by hash; the language with the
    most labelled documents comes first."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    counts = {r.lang: r.n for r in rows.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    part = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, per_language / n) * (1 << 30))))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(1 << 30)) <= part[F.col("lang").cast("string")])
    out: dict[str, list[bytes]] = {}
    texts = chosen.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.lit(47)).alias("turn"), "text").orderBy("turn", "text")
    for r in texts.toLocalIterator():
        have = out.setdefault(r.lang, [])
        if sum(map(len, have)) < size:
            have.append(normalise(r.text)[: min(PER_DOCUMENT, size // 8)])  # several documents, not one long one
    return {k: b" ".join(out[k])[:size] for k in sorted(out, key=lambda k: (-counts[k], k)) if any(out[k])}


class Encoder:
    def __init__(self, held: dict[str, bytes]):
        self.names = list(held)
        self.coders = [self._of(held[name]) for name in self.names]

    @staticmethod
    def _of(content: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, body: bytes, piece: int = PIECE) -> list[int]:
        """Encoded bytes under each language, whole text."""
        return [sum(len(e.compress(body[i : i + piece])) for i in range(0, len(body), piece)) for e in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, bool, float]:
        """Language, score from 0 to 1, whether the margin is narrow, and the margin in bits a byte."""
        body = normalise(text)
        body = b" " + body + b" " if body else body
        if not body or not self.names:
            return "und", 0.0, True, 0.0
        n = np.array(self.sizes(body), float)
        order = np.argsort(n, kind="stable")
        margin = float(n[order[1]] - n[order[0]]) * 8 / len(body) if len(n) > 1 else 8.0
        p = np.exp(-np.minimum((n - n[order[0]]) * 8 / len(body) * 4, 50))
        return self.names[order[0]], float(p[order[0]] / p.sum()), margin < MARGIN, margin


def predict(docs: DataFrame, held: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected, margin of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(held)  # at most DICTIONARY bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for block in X.blocks(batches):
            got = [encoder.predict(t) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *[pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.float64()))]], names=["doc_id", "lang_pred", "score", "rejected", "margin"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean, margin double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = dictionaries(docs, remainder("doc_id", 4) != 2)
    out = predict(docs, held)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected", "margin")
