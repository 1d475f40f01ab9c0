"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed over cells of source, language and topic. Raking scales the cells in turn until their
sums meet the target shares of every source, language and topic; a document's probability is its cell's
calibrated share of the token budget over the cell's tokens, at most 1, with what capped cells cannot take
given to the others. Documents are drawn by a hash of their id and text, so a run can be repeated.

Topics are clusters of documents by the words they hold, learnt over all of them: spherical k-means on hashed words
that weigh the more the fewer documents hold them. A column of topics of one's own can be given instead. Targets can be
given for each value of an axis; what is not given has its share of the tokens, tempered.

The table of cells is fitted on the driver while it has at most `max_cells` rows, which is checked; a
larger one is fitted by aggregations and joins over its written form, by the same rules."""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, placeable, with_groups, without_places

AXES = ("source", "lang", "topic")
#: Target shares are powers of the shares found: 1 keeps them, 0 makes all alike.
TEMPERATURE = {"source": 0.7, "lang": 0.7, "topic": 0.9}
BUDGET = 0.7
MAX_CELLS = 200_000
#: Topics, buckets of hashed words, and rounds over all documents in which topics are learnt.
TOPICS, BUCKETS, TOPIC_ROUNDS = 12, 512, 3
#: A document counts a token for each word, or for so many characters where that is more.
CHARS_PER_TOKEN = 8
#: Raking stops when the worst marginal is off by less than this share; after so many rounds, or in a standstill, it reports what is left.
TOLERANCE, ROUNDS = 1e-9, 200


class Buckets(dict):
    """Bucket of each word, emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        return found


def present(text: str | None, buckets: Buckets) -> tuple[bytes, int]:
    """(how often a whole text holds words of each bucket, as a byte of its logarithm; the text's tokens)."""
    words = (text or "").lower().split()
    at = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
    logs = np.minimum(255, np.round(16 * np.log1p(np.bincount(at, minlength=BUCKETS)))).astype(np.uint8)
    return logs.tobytes(), max(1, len(words), -(-len(text or "") // CHARS_PER_TOKEN))


@dataclass
class Topics:
    """Weights of buckets and unit centres (TOPICS, BUCKETS)."""

    weight: np.ndarray
    centres: np.ndarray

    def vectors(self, logs: np.ndarray) -> np.ndarray:
        x = logs * self.weight
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-12))

    def of(self, x: np.ndarray) -> np.ndarray:
        """Nearest topic of each vector, the first of equally near ones; -1 where nothing is counted."""
        if not len(self.centres):
            return np.full(len(x), -1)
        return np.where(x.any(axis=1), (x @ self.centres.T).argmax(axis=1), -1)


def _logs(column: pa.Array, at: int, n: int = 1024) -> np.ndarray:
    return np.frombuffer(b"".join(column.slice(at, n).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.float32)


def learn_topics(rows: DataFrame, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> Topics:
    """Topics of all rows of a written table with a column `words` as of present. They start at the rows of the smallest hashes;
    tasks sum up their own rows in each round, and at most topics times BUCKETS sums reach the driver."""
    rows = rows.select("words")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                logs = _logs(b.column(0), at)
                total, n = total + (logs > 0).sum(axis=0), n + len(logs)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS, dtype=np.int32)), pa.array(np.r_[n, total])], names=["bucket", "n"])

    found = {r.bucket: r.n for r in rows.mapInArrow(held, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    n = found.get(-1, 0)
    weight = np.log((1 + n) / (1 + np.array([found.get(k, 0) for k in range(BUCKETS)], float))).astype(np.float32)
    hashed = rows.withColumn("h", F.xxhash64("words"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(topics).collect()]
    first = sorted(hashed.where(F.col("h").isin(least)).groupBy("h").agg(F.min("words").alias("words")).collect()) if least else []
    starts = Topics(weight, np.zeros((0, BUCKETS), np.float32)).vectors(np.array([np.frombuffer(r.words, np.uint8) for r in first], np.float32).reshape(-1, BUCKETS))
    model = Topics(weight, starts[starts.any(axis=1)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(model.centres) + 1, BUCKETS))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                x = model.vectors(_logs(b.column(0), at))
                own = model.of(x)
                for k in range(len(model.centres)):
                    total[k] += x[own == k].sum(axis=0, dtype=np.float64)
        topic, bucket = np.nonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(topic.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[topic, bucket])], names=["topic", "bucket", "x"])

    for _ in range(rounds if len(model.centres) else 0):
        table = rows.mapInArrow(sums, "topic int, bucket int, x double").groupBy("topic", "bucket").agg(F.sum("x").alias("x")).toArrow()
        centres = np.zeros(model.centres.shape)
        centres[table.column("topic").to_numpy(), table.column("bucket").to_numpy()] = table.column("x").to_numpy()
        size = np.linalg.norm(centres, axis=1, keepdims=True)
        new = np.where(size > 0, centres / np.maximum(size, 1e-12), model.centres)
        model = Topics(weight, new.round(7).astype(np.float32))  # sums come in any order
    return model


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, keep: tuple[Column, ...] = ()) -> DataFrame:
    """(id, source, lang, topic, u, kept columns, words, n_tokens) for each row; null names are empty names.

    u is a number in 0..1 made from the id and the text alone; topic is empty without a column of topics."""
    text = F.col(text_col).cast("string")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    u = F.pmod(F.xxhash64(F.col(id_col).cast("long"), text, F.lit("mixing")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = docs.select(text.alias("t"), F.col(id_col).cast("long").alias("id"), name(source_col).alias("source"), name(lang_col).alias("lang"), (name(topic_col) if topic_col else F.lit("")).alias("topic"), u.alias("u"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [present(t, buckets) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=[*part.schema.names[1:], "words", "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(run, f"{schema}, words binary, n_tokens long")


def with_topics(rows: DataFrame, model: Topics) -> DataFrame:
    """rows with `topic` from `words`; what holds no words has the topic `none`."""
    names = rows.columns
    topic, words = names.index("topic"), names.index("words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.concatenate([np.zeros(0, np.int64), *[model.of(model.vectors(_logs(b.column(words), at))) for at in range(0, b.num_rows, 1024)]])
            new = pa.array(["none" if k < 0 else f"topic{k}" for k in own.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == topic else c for k, c in enumerate(b.columns)], names=names)

    return rows.mapInArrow(run, rows.schema)


Targets = Mapping[str, Mapping[str, float]]


def targets(sums: Mapping[str, float], power: float, given: Mapping[str, float] | None = None) -> dict[str, float]:
    """Target shares of the values of one axis, which add up to 1.

    Given shares hold; other values divide what is left by their shares of the tokens raised to a power. If nothing is left, they
    get nothing; given values that do not occur count for nothing."""
    total = sum(sums.values())
    own = {k: float(v) for k, v in (given or {}).items() if k in sums}
    raised = {k: (v / total) ** power for k, v in sums.items() if k not in own}
    whole, left = sum(raised.values()), max(0.0, 1 - sum(own.values()))
    goal = own | {k: v / whole * left for k, v in raised.items()}
    scale = sum(goal.values())
    return {k: v / scale for k, v in goal.items()}


def _report(worst: float, rounds: int, tolerance: float) -> None:
    if worst >= tolerance:
        warnings.warn(f"raking left a marginal off by {worst:.3g} of all tokens after {rounds} rounds; the targets may not be reachable", RuntimeWarning, stacklevel=3)


def stalled(errors: list[float], span: int = 10, least: float = 1e-4) -> bool:
    """Whether the error has stayed the same, to a relative `least`, over the last `span` rounds: unreachable targets end in a cycle."""
    return len(errors) > span and max(errors[-span - 1 :]) - min(errors[-span - 1 :]) <= least * errors[-1]


def rake(tokens: np.ndarray, axes: list[np.ndarray], goals: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Shares of cells, started from their tokens, that meet every axis's goals. axes: a cell's value on each axis."""
    share, errors = tokens / tokens.sum(), []
    for _ in range(rounds):
        worst = 0.0
        for at, goal in zip(axes, goals, strict=True):
            sums = np.bincount(at, share, len(goal))
            scale = np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)
            worst = max(worst, np.abs(sums - goal).max())
            share = share * scale[at]
        errors.append(worst)
        if worst < tolerance or stalled(errors):
            break
    _report(worst, len(errors), tolerance)
    return share / share.sum()


def probabilities(tokens: np.ndarray, share: np.ndarray, budget: float) -> np.ndarray:
    """min(1, factor * share / tokens) with the factor that spends the budget, a part of all tokens."""
    if budget >= 1:
        return (share > 0).astype(float)
    goal, n = budget * tokens.sum(), -1
    factor = goal
    while True:  # capped cells are full; the others share what is left, until none is newly capped
        capped = factor * share >= tokens
        if np.count_nonzero(capped) <= n or not share[~capped].sum():
            return np.minimum(1, factor * share / tokens)
        n = np.count_nonzero(capped)
        factor = max(factor, (goal - tokens[capped].sum()) / share[~capped].sum())


def _small(cells: DataFrame, temperature: Mapping[str, float], budget: float, given: Targets) -> DataFrame:
    rows = sorted(cells.collect())
    if not rows:
        return cells.select(*AXES, F.lit(0.0).alias("target_share"), F.lit(0.0).alias("probability"))
    tokens = np.array([r.tokens for r in rows], float)
    axes, goals = [], []
    for axis in AXES:
        names, at = np.unique([r[axis] for r in rows], return_inverse=True)
        sums = np.bincount(at, tokens, len(names))
        found = targets(dict(zip(names.tolist(), sums.tolist(), strict=True)), temperature[axis], given.get(axis))
        axes.append(at)
        goals.append(np.array([found[n] for n in names.tolist()]))
    share = rake(tokens, axes, goals)
    p = probabilities(tokens, share, budget)
    out = [(*(r[a] for a in AXES), float(s), float(q)) for r, s, q in zip(rows, share, p, strict=True)]
    return cells.sparkSession.createDataFrame(out, "source string, lang string, topic string, target_share double, probability double")


def _large(cells: DataFrame, temperature: Mapping[str, float], budget: float, given: Targets, rounds: int = ROUNDS, tolerance: float = TOLERANCE, max_values: int = MAX_CELLS) -> DataFrame:
    """The same over a table of any size, by the same stopping rules: each axis's sums are joined back to the cells, one table per round."""
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("share", F.col("tokens") / F.lit(float(total)))
    goals = {}
    for axis in AXES:
        g = now.groupBy(axis).agg(F.pow(F.sum("share"), F.lit(temperature[axis])).alias("raised"))
        own = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.get(axis, {}).items()], f"{axis} string, own double")
        g = cut(g.join(own, axis, "left"))
        whole, taken = g.agg(F.sum(F.when(F.col("own").isNull(), F.col("raised"))), F.sum("own")).first()
        left = max(0.0, 1 - (taken or 0.0))
        scale = (taken or 0.0) + (left if whole else 0.0)
        goals[axis] = cut(g.select(axis, (F.coalesce("own", F.col("raised") * F.lit(left / (whole or 1.0))) / F.lit(scale)).alias("goal")))
    errors = []
    for _ in range(rounds):
        worst = 0.0
        for axis in AXES:
            found = now.groupBy(axis).agg(F.sum("share").alias("found")).join(goals[axis].hint("merge"), axis)
            scale = cut(found.select(axis, F.when(F.col("found") > 0, F.col("goal") / F.col("found")).otherwise(0.0).alias("scale"), F.abs(F.col("found") - F.col("goal")).alias("off")))
            off, values = scale.agg(F.max("off"), F.count("*")).first()
            worst, scale = max(worst, off), scale.drop("off")
            now = (now.join(F.broadcast(scale), axis) if values <= max_values else with_groups(now, scale, axis, AXES)).withColumn("share", F.col("share") * F.col("scale")).drop("scale")
        now = cut(now)
        errors.append(worst)
        if worst < tolerance or stalled(errors):
            break
    _report(worst, len(errors), tolerance)
    whole = now.agg(F.sum("share")).first()[0]
    now = now.withColumn("share", F.col("share") / F.lit(whole))
    if budget >= 1:
        return now.select(*AXES, F.col("share").alias("target_share"), F.when(F.col("share") > 0, 1.0).otherwise(0.0).alias("probability"))
    goal, n = budget * total, -1
    factor = goal
    while True:  # as in probabilities
        capped = F.lit(factor) * F.col("share") >= F.col("tokens")
        count, full, rest = now.agg(F.count_if(capped), F.sum(F.when(capped, F.col("tokens")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("share")))).first()
        if count <= n or not rest:
            break
        n, factor = count, max(factor, (goal - full) / rest)
    return now.select(*AXES, F.col("share").alias("target_share"), F.least(F.lit(1.0), F.lit(factor) * F.col("share") / F.col("tokens")).alias("probability"))


def calibrate(rows: DataFrame, temperature: Mapping[str, float] = TEMPERATURE, budget: float = BUDGET, max_cells: int = MAX_CELLS, given: Targets | None = None) -> tuple[DataFrame, bool]:
    """((source, lang, topic, target_share, probability), whether that table was within max_cells)."""
    cells = cut(rows.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")))
    small = cells.limit(max_cells + 1).count() <= max_cells
    return (_small if small else _large)(cells, temperature, budget, given or {}), small


def _with_probabilities(rows: DataFrame, cells: DataFrame, small: bool) -> DataFrame:
    """rows (with _file, _row) and their cells' target_share and probability. At most max_cells cells are broadcast; more are joined, hot ones salted."""
    if small:
        return rows.join(F.broadcast(cells), list(AXES))
    key = F.struct(*AXES)
    return with_groups(rows.withColumn("cell", key), cells.select(key.alias("cell"), "target_share", "probability"), "cell", ["_file", "_row"]).drop("cell")


def mixture(docs: DataFrame, topic_col: str | None = None, **options) -> DataFrame:
    """Per row: (id, source, lang, topic, n_tokens, target_share, probability, sampled, _file, _row).

    Rows are drawn by their id and text, so repeated rows are drawn alike and rows without an id each by their text. Null
    names are a value of their axis; a null or empty text is one token; an empty table gives none. Texts are read whole."""
    docs = placeable(docs)
    place = docs.metadataColumn("_metadata")
    rows = cut(described(docs, topic_col=topic_col, keep=(place["file_path"].alias("_file"), place["row_index"].alias("_row"))))
    rows = cut((rows if topic_col else with_topics(rows, learn_topics(rows))).drop("words"))
    return _with_probabilities(rows, *calibrate(rows, **options)).withColumn("sampled", F.col("u") < F.col("probability")).drop("u")


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of docs, as mixture draws them, with all their columns."""
    docs = placeable(docs)
    gone = cut(mixture(docs, **options).where("NOT sampled").select("_file", "_row"))
    return without_places(docs, gone)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Per document: its cell, tokens, target share, calibrated probability and whether it is drawn."""
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id").drop("_file", "_row")
