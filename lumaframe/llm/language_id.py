"""Language identification with string kernels.

A piece of a text is the set of its byte n-grams of lengths 1 to SPECTRUM, hashed to 2^BITS places (the blended spectrum). The kernel of two
pieces is the number of n-grams both have, over the root of the product of their numbers. Landmark pieces span the Nystrom approximation
and one kernel ridge regressor for each language is fitted on it; batches of pieces are scored by two matrix products. A text is cut into
equal pieces of at most PIECE bytes, which together hold all its n-grams, and its margins are their means: in one long set nearly every
n-gram would be present, whatever the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lumaframe.llm.common import documents, held_out, materialize, small_batches, text_bytes

SPECTRUM, BITS, PIECE = 4, 13, 2048
#: Labelled pieces for each language that training uses at most, those of them that are landmarks, and the ridge.
PER_LANGUAGE, LANDMARKS, RIDGE = 600, 48, 1e-3
#: Turns the margins into scores.
SHARPNESS = 8.0
#: Pieces of a matrix product.
BLOCK = 256
UNKNOWN = "und"


def cuts(n_bytes: int) -> tuple[int, int]:
    """(pieces, bytes of each but the last) of a text."""
    pieces = max(1, -(-n_bytes // PIECE))
    return pieces, max(1, -(-n_bytes // pieces))


def mark(row: np.ndarray, piece: bytes, starts: int) -> None:
    """Set row to 1 at the places of the n-grams that begin in the first `starts` bytes of piece."""
    b = np.frombuffer(piece.lower(), np.uint8).astype(np.uint32)
    h = np.zeros(len(b) + 1, np.uint32)
    for n in range(1, min(SPECTRUM, len(b)) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ (b[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        row[h[:starts] >> np.uint32(32 - BITS)] = 1.0


def presence(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the texts, their presence rows) of all pieces of the texts, BLOCK by BLOCK; a block is reused."""
    block, owners = np.zeros((BLOCK, 1 << BITS), np.float32), []
    for t, text in enumerate(texts):
        pieces, size = cuts(len(text))
        for k in range(pieces):
            mark(block[len(owners)], text[k * size : (k + 1) * size + SPECTRUM - 1], size)
            owners.append(t)
            if len(owners) == BLOCK:
                yield np.array(owners), block
                owners = []
                block[:] = 0
    if owners:
        yield np.array(owners), block[: len(owners)]


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))
    return a @ b.T / size


def _rows(packed: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(packed), np.uint8)).reshape(-1, 1 << BITS).astype(np.float32)


def fit(pieces: list[bytes], languages: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(landmarks, weights, the languages): kernel(rows, landmarks) @ weights gives a margin for each language. pieces: packed presence rows."""
    names = sorted(set(languages))
    if not names:
        return np.zeros((1, 1 << BITS), np.float32), np.zeros((1, 0)), []
    order = {n: [k for k, x in enumerate(languages) if x == n] for n in names}
    marks = _rows([pieces[k] for k in sorted(k for n in names for k in order[n][:LANDMARKS])])
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    use = value > 1e-6 * value.max()
    whiten = vector[:, use] / np.sqrt(value[use])
    phi = np.concatenate([kernel(_rows(pieces[k : k + BLOCK]), marks) @ whiten for k in range(0, len(pieces), BLOCK)])
    target = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    weight = np.array([1 / len(order[n]) for n in languages])[:, None] * len(languages) / len(names)
    beta = np.linalg.solve(phi.T @ (weight * phi) + RIDGE * len(pieces) * np.eye(phi.shape[1]), phi.T @ (weight * target))
    return marks, whiten @ beta, names


def margins(texts: list[bytes], model: tuple[np.ndarray, np.ndarray, list[str]]) -> np.ndarray:
    """The mean margins of each text's pieces."""
    marks, weights, names = model
    total, count = np.zeros((len(texts), len(names))), np.zeros(len(texts))
    for owners, rows in presence(texts):
        np.add.at(total, owners, kernel(rows, marks) @ weights)
        count += np.bincount(owners, minlength=len(texts))
    return total / count[:, None]


def train(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """fit() on at most PER_LANGUAGE pieces a language of the rows of docs(doc_id, text, lang) that have all three and aren't held out.

    The pieces are those of smallest hash. Those far above it leave by a threshold before anything is dealt, so no language gathers its
    rows in a task; a piece reaches the driver as 2^BITS bits.
    """
    known = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~held_out("doc_id", 3, 1))
    known = known.select("doc_id", "lang", "text", F.xxhash64("text").alias("hash"), F.greatest(F.ceil(F.octet_length("text") / PIECE), F.lit(1)).cast("int").alias("pieces"))
    share = (F.lit(1.2 * PER_LANGUAGE * (1 << 30)) / F.sum("pieces")).cast("long").alias("most")
    shares = materialize(known.groupBy(F.col("lang").alias("name")).agg(share), "languages")
    size = F.greatest(F.ceil(F.octet_length("text") / F.col("pieces")), F.lit(1)).cast("int")
    # Pieces are chosen by their numbers, so that a long text isn't copied for each.
    chosen = F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: F.pmod(F.xxhash64("doc_id", "hash", k), F.lit(1 << 30)) < F.col("most"))
    cut = F.transform(chosen, lambda k: F.struct(F.xxhash64("doc_id", "hash", k).alias("place"), F.substring(F.encode("text", "UTF-8"), k * size + 1, size + SPECTRUM - 1).alias("piece")))
    cut = known.join(shares, F.col("lang") == F.col("name")).select("lang", size.alias("starts"), F.explode(cut).alias("p")).select("lang", "starts", "p.place", "p.piece")

    def run(batches):
        for b in small_batches(batches):
            rows = np.zeros((b.num_rows, 1 << BITS), np.float32)
            for row, piece, starts in zip(rows, b.column("piece").to_pylist(), b.column("starts").to_pylist(), strict=True):
                mark(row, piece, starts)
            bits = pa.array([x.tobytes() for x in np.packbits(rows.astype(bool), axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("place"), bits], ["lang", "place", "bits"])

    got = cut.mapInArrow(run, "lang string, place long, bits binary").dropDuplicates(["lang", "place"]).toPandas()
    got["order"] = got["place"] % (1 << 30)
    got = got.sort_values(["lang", "order", "place"], kind="stable")
    got = got[got.groupby("lang").cumcount() < PER_LANGUAGE]
    return fit(got["bits"].tolist(), got["lang"].tolist())


def predict(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, list[str]]) -> DataFrame:
    """docs, all columns, with lang_pred and score added; columns of those names are replaced.

    Null texts and texts without a letter give UNKNOWN and score 0, as all do if nothing was learned. Ties go to the first name. Long
    texts are scored whole, piece by piece; equal rows score alike; an empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        names = shared.value[2]
        for b in small_batches(batches, 256):
            texts = text_bytes(b.column("text"))
            found = margins(texts, shared.value)
            e = np.exp(SHARPNESS * (found - found.max(1, initial=-1.0)[:, None]))
            p = e / e.sum(1)[:, None] if names else e
            ok = [bool(names) and any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in texts]
            best = p.argmax(1) if names else np.zeros(len(texts), np.int64)
            lang = [names[k] if o else UNKNOWN for k, o in zip(best, ok, strict=True)]
            score = [float(row[k]) if o else 0.0 for row, k, o in zip(p, best, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
