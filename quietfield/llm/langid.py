"""Language identification in two steps: the family first, then the language within it.

Texts become hashed counts of character n-grams (1 to 4 letters of words, with word boundaries), of unit
length. Linear support vector machines, one against the rest, choose the language family; within it, one
against one, machines separate its languages by votes. Both are trained in numpy on a bounded sample of
labelled rows that the executors turn into counts; every row is scored where it lies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1 << 12
#: About so many labelled rows of each language are trained on.
SAMPLE_PER_LANG = 500
#: So many languages are learnt at most, those with the most rows.
MAX_LANGS = 200
UNKNOWN = "und"
#: Families by ISO 639-1 code (fixed values). A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd gv",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "iranic": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su tl",
}


def family(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang in v.split()), lang)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, or None where it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = np.r_[np.uint32(32), codes, np.uint32(32)]
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    h, out = np.zeros(len(codes), np.uint32), []
    for n in range(1, 5):
        if n > len(codes):
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :] * np.uint32(0x9E3779B1)
        out.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(20))
    return np.bincount(np.concatenate(out), minlength=DIM).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    x = np.sqrt(x)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, steps: int = 1500, batch: int = 64, penalty: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear support vector machine by averaged stochastic subgradients; y is +1 or -1, classes weigh the same."""
    rng = np.random.default_rng(seed)
    groups = [np.flatnonzero(y > 0), np.flatnonzero(y < 0)]
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    mean_w, mean_b = np.zeros_like(w), 0.0
    for t in range(1, steps + 1):
        rows = np.concatenate([rng.choice(g, batch // 2) for g in groups])
        wrong = rows[y[rows] * (x[rows] @ w + b) < 1]
        rate = 4.0 / (1 + 0.01 * t)
        w *= 1 - rate * penalty
        if len(wrong):
            w += rate / batch * (y[wrong] @ x[wrong])
            b += rate / batch * 0.1 * float(y[wrong].sum())
        if t > steps // 2:
            mean_w += w
            mean_b += b
    k = steps - steps // 2
    return mean_w / k, mean_b / k


@dataclass
class Model:
    """Columns of weights: one for each family (if there are two or more), then one for each pair within a family."""

    families: list[str]
    members: dict[str, list[str]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores in 0..1 of rows of counts: the family's probability times the language's."""
        margins = unit(x) @ self.weights + self.bias
        n = len(self.families) if len(self.families) > 1 else 0
        if n:
            e = np.exp(3 * (margins[:, :n] - margins[:, :n].max(axis=1, keepdims=True)))
            e /= e.sum(axis=1, keepdims=True)
            chosen, score = e.argmax(axis=1), e.max(axis=1)
        else:
            chosen, score = np.zeros(len(x), int), np.ones(len(x))
        langs, at = np.empty(len(x), object), n
        for k, f in enumerate(self.families):
            names, own = self.members[f], np.flatnonzero(chosen == k)
            pairs = list(combinations(range(len(names)), 2))
            votes = np.zeros((len(own), len(names)))
            for j, (a, b) in enumerate(pairs):
                p = 1 / (1 + np.exp(-3 * margins[own, at + j]))
                votes[:, a] += p
                votes[:, b] += 1 - p
            at += len(pairs)
            best = votes.argmax(axis=1) if len(own) else np.zeros(0, int)
            langs[own] = np.array(names, object)[best]
            if pairs and len(own):
                score[own] *= votes.max(axis=1) / (len(names) - 1)
        return langs.tolist(), np.clip(score, 0, 1)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    x, names = unit(x), sorted(set(langs))
    members: dict[str, list[str]] = {}
    for name in names:
        members.setdefault(family(name), []).append(name)
    families = sorted(members)
    lang, fam = np.array(langs, object), np.array([family(v) for v in langs], object)
    found = [machine(x, np.where(fam == f, 1.0, -1.0).astype(np.float32)) for f in families] if len(families) > 1 else []
    for f in families:
        for a, b in combinations(members[f], 2):
            rows = np.flatnonzero((lang == a) | (lang == b))
            found.append(machine(x[rows], np.where(lang[rows] == a, 1.0, -1.0).astype(np.float32)))
    weights = np.column_stack([w for w, _ in found]) if found else np.zeros((DIM, 0), np.float32)
    return Model(families, members, weights.astype(np.float32), np.array([b for _, b in found], np.float32))


def train(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """A model from (id, text, lang) rows: about sample_per_lang of each of MAX_LANGS languages, chosen by a hash of id and text.

    Repeated rows count once. Counts of 16-bit floats reach the driver, 8 kB a row, so 4 MB a language; twice the sample is a firm
    bound. Texts are read whole; ties between languages go to the first name. None without a usable row, as of an empty table."""
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_per_lang / n))])[F.col("lang")]
    hashed = labelled.withColumn("h", F.xxhash64(F.col("id").cast("string"), F.col("text").cast("string"), F.lit("langid")))
    chosen = hashed.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(lang, h, c) for t, lang, h in zip(*(c.to_pylist() for c in b.columns), strict=True) if (c := counts(t)) is not None]
            lang, h = ([r[k] for r in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(h, pa.int64()), pa.array([unit(r[2]).astype(np.float16).tobytes() for r in found], pa.binary())], names=["lang", "h", "x"])

    found = chosen.select(F.col("text").cast("string"), "lang", "h").mapInArrow(run, "lang string, h long, x binary").groupBy("lang", "h").agg(F.first("x").alias("x"))
    rows = sorted(found.select("lang", "x").limit(2 * sample_per_lang * len(sizes)).collect())
    if not rows:
        return None
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float16).reshape(len(rows), DIM).astype(np.float32)
    return fit(x * x, [r.lang for r in rows])  # fit takes the root again


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] = ()) -> DataFrame:
    """(id, lang_pred, score, kept columns) for each row; `und` and 0 for null and letterless texts, and for all without a model.

    Texts are read whole, repeated rows predicted alike, of languages with equal votes the first by name is taken, null ids stay
    null, and an empty table gives none."""
    keep_cols = [F.col(id_col).cast("long").alias(id_col), *keep]
    frame = docs.select(F.col(text_col).cast("string").alias("_text"), *keep_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            for at in range(0, b.num_rows, 512):
                found = [(at + k, c) for k, t in enumerate(b.column(0).slice(at, 512).to_pylist()) if model is not None and (c := counts(t)) is not None]
                if found:
                    names, values = model.predict(np.stack([c for _, c in found]))
                    for (k, _), name, value in zip(found, names, values, strict=True):
                        langs[k], scores[k] = name, value
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, pa.string()), pa.array(scores)], names=[*b.schema.names[1:], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema[1:])
    return frame.mapInArrow(run, f"{schema}, lang_pred string, score double")


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter, as counts() sees it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [any(map(str.isalpha, (t or "").lower())) for t in b.column(b.num_columns - 1).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_())).select(range(b.num_columns - 1))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # mapInArrow resolves names, and these may hold dots
    text = F.col(f"c{docs.columns.index(text_col)}").cast("string").alias("letters_of")
    return plain.select("*", text).mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the id falls into the quarter that is never learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from the rows of docs that are not held out and have a language."""
    return train(docs.where(~held_out(id_col) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Per document: whether it was held out, its predicted language and the score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
