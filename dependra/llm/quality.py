"""Quality classifier: compression against dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled text, one from rows of label 1 and one from rows of label 0. A text
is compressed with either, in blocks (so that the dictionary keeps its weight in long texts) and to its end. The
difference of the two sizes, normalised by their sum, is calibrated to a probability by a logistic curve whose other
terms are the size relative to the text and the length, both of them compressed sizes too.

Defined cases: null and empty texts get the score of a difference of zero and no length. Without labels of both
classes the score is the share of label 1, smoothed (0.5 without labels). Null labels and null doc_ids teach nothing; repeated labels and
rows with one doc_id teach once (by the smallest text). Other columns of the input pass through.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dependra.llm.common import sampled, table, with_python


@dataclasses.dataclass
class CompressionClassifier:
    good: bytes
    bad: bytes
    weights: list[float]
    block: int = 1024
    level: int = 3

    def compressors(self):
        out = []
        for data in (self.good, self.bad):
            kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            plain = {"level": self.level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if len(data) >= 8:
                held = zstandard.ZstdCompressionDict(data, dict_type=kind)
                held.precompute_compress(level=self.level)
                plain["dict_data"] = held
            out.append(zstandard.ZstdCompressor(**plain).compress)
        return out

    def features(self, texts: list[str | None], compressors=None) -> np.ndarray:
        good, bad = compressors or self.compressors()
        out = np.zeros((len(texts), 6))
        for row, text in zip(out, texts):
            data = text.encode("utf-8", "surrogatepass") if text else b""
            row[0] = 1
            if not data:
                continue
            g = b = 0
            for i in range(0, len(data), self.block):
                part = data[i : i + self.block]
                g += len(good(part))
                b += len(bad(part))
            diff, ratio, size = (b - g) / (b + g), min(b, g) / len(data), np.log1p(len(data)) / 8
            row[1:] = diff, diff * size, min(ratio, 1.5), np.exp(-8 * ratio), size
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02) -> np.ndarray:
    """Newton's method on the penalised likelihood."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(parts: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the samples themselves
        return b"".join(parts)[-size:]


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, dict_bytes: int = 112_640, block: int = 1024, blocks_per_doc: int = 4, seed: int = 11) -> CompressionClassifier:
    """Learns from labels (doc_id, quality) and the texts of docs.

    The bounds of the sample are parameters: about per_class documents of each class teach the dictionary, by at most
    blocks_per_doc blocks spread over the whole of a text, and as many others fit the calibration, by whole texts.
    """
    some = sampled(labels.where("quality in (0, 1) and doc_id is not null").selectExpr("doc_id", "cast(quality as int) quality").distinct(), "quality", 2 * per_class, "doc_id", seed)
    some = some.withColumn("role", F.expr(f"pmod(xxhash64(doc_id, {seed + 1}), 2)"))
    # Bounded by the parameters: 4 * per_class ids.
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where("text <> ''")
    # Rows with one doc_id, however many, are one text of the sample.
    texts = texts.groupBy("doc_id", "quality", "role").agg(F.min("text").alias("text"))

    def blocks(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for quality, text in zip(b.column("quality").to_pylist(), b.column("text").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                n = -(-len(data) // block)
                for k in sorted({i * n // blocks_per_doc for i in range(blocks_per_doc)}):
                    rows.append((quality, data[k * block : (k + 1) * block]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["quality", "part"])

    parts = {0: [], 1: []}
    for r in texts.where("role = 0").select("quality", "text").mapInArrow(blocks, "quality int, part binary").collect():
        parts[r[0]].append(bytes(r[1]))
    parts = {k: sorted(v) for k, v in parts.items()}
    rng = np.random.default_rng(seed)
    parts = {k: [v[i] for i in rng.permutation(len(v))] for k, v in parts.items()}
    model = CompressionClassifier(_dictionary(parts[1], dict_bytes), _dictionary(parts[0], dict_bytes), [0.0] * 6, block)

    def make():
        both = model.compressors()
        return lambda b: [list(model.features(b.column("text").to_pylist(), both))]

    rows = with_python(texts.where("role = 1").select("quality", "text"), make, "x array<double>", ["quality"]).collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    y = np.array([r[0] for r in rows], float)
    if 0 < y.sum() < len(y):
        model.weights = [float(v) for v in _logistic(np.array([r[1] for r in rows]), y)]
    else:
        p = (y.sum() + 1) / (len(y) + 2)
        model.weights = [float(np.log(p / (1 - p))), 0.0, 0.0, 0.0, 0.0, 0.0]
    return model


def score_quality(docs: DataFrame, model: CompressionClassifier, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold)."""

    def make():
        both = model.compressors()

        def score(batch):
            s = model.scores(model.features(batch.column("text").to_pylist(), both))
            return [s, (s >= threshold).astype(np.int32)]

        return score

    return with_python(docs, make, "score double, predicted int", keep)


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where("pmod(crc32(cast(doc_id as string)), 5) <> 0")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, learnable(table(spark, sf_dir, "labels")))
    return score_quality(docs, model, keep=["doc_id"]).selectExpr("doc_id", "coalesce(pmod(crc32(cast(doc_id as string)), 5) = 0, true) held_out", "score", "predicted")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: score under 0.3, for null and empty texts too. Repeated rows are each judged; an empty table
    stays empty."""
    columns = docs.columns
    model = fit_quality(docs, learnable(table(spark, sf_dir, "labels")))
    return score_quality(docs, model).where("predicted = 1").select(*columns)
