"""Leakage probes: can labels be guessed from what should not tell them? Made for labelled sets of audit size."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridict.functions.text import mixed_tokens
from veridict.sources.tables import shared

SMOOTHING = 1.0
PERMUTATIONS, ORDER_PERMUTATIONS, SEED = 500, 2000, 7
MIN_LEAF, MAX_DEPTH = 3, 2
#: Counts by token, permutation and class that are held at once: with their logarithms some 400 MB in a task. Each set of
#: permutations reads all texts again, so few permutations at a time take many passes.
CELLS = 1 << 25


def label_baselines(rows: DataFrame) -> DataFrame:
    """Shares that guessing the largest class, and guessing in proportion, would get."""
    sums = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    return sums.agg(n.alias("n"), (F.max("n") / n).alias("majority"), F.round(F.sum(F.col("n") * F.col("n")) / (n * n), 9).alias("stratified"))


def token_counts(rows: DataFrame) -> DataFrame:
    """Long bag of words: instance_id, label, token, times."""
    return rows.select("instance_id", "label", F.explode(mixed_tokens(F.col("text"))).alias("token")).groupBy("instance_id", "label", "token").agg(F.count(F.lit(1)).alias("times"))


def bayes_counts(rows: DataFrame) -> DataFrame:
    """Sufficient statistics per class: documents, tokens, distinct tokens."""
    docs = rows.groupBy("label").agg(F.count(F.lit(1)).alias("documents"))
    tokens = token_counts(rows).groupBy("label").agg(F.sum("times").alias("tokens"), F.count_distinct("token").alias("vocabulary"))
    return docs.join(tokens, "label", "left").select("label", "documents", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"))


def leave_one_out_bayes(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Prediction of each row by a naive Bayes model of all the others, without refitting: the row's own counts are
    taken off the full ones. ``extra`` names columns (such as a permutation) within which everything is done apart."""
    on = list(extra)
    own = rows.select(*on, "instance_id", "label", F.explode(mixed_tokens(F.col("text"))).alias("token")).groupBy(*on, "instance_id", "label", "token").agg(F.count(F.lit(1)).alias("o"))
    sizes = own.groupBy(*on, "instance_id").agg(F.sum("o").alias("len"))
    classes = rows.groupBy(*on, "label").agg(F.count(F.lit(1)).alias("in_class"))
    totals = own.groupBy(*on, "label").agg(F.sum("o").alias("T"))
    overall = own.groupBy(*on, "label", "token").agg(F.sum("o").alias("C")).groupBy(*on, "token").agg(F.sum("C").alias("G"), F.collect_list(F.struct("label", "C")).alias("per_class"))
    met = own.withColumnRenamed("label", "truth").join(overall, [*on, "token"])
    lonely = met.where("G = o").groupBy(*on, "instance_id").agg(F.count(F.lit(1)).alias("only_here"), F.sum("o").alias("alone"))
    vocabulary = overall.groupBy(*on).agg(F.count(F.lit(1)).alias("V")) if on else overall.agg(F.count(F.lit(1)).alias("V"))
    count = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("all")) if on else rows.agg(F.count(F.lit(1)).alias("all"))
    meet = (lambda a, b: a.join(b, on)) if on else (lambda a, b: a.crossJoin(F.broadcast(b)))  # one row
    base = meet(meet(rows.select(*on, "instance_id", F.col("label").alias("truth")), count), vocabulary)
    base = base.join(sizes, [*on, "instance_id"], "left").join(lonely, [*on, "instance_id"], "left").na.fill(0, ["len", "only_here", "alone"])
    stats = classes.join(totals, [*on, "label"], "left").na.fill(0, ["T"])
    cand = meet(base, stats) if on else base.crossJoin(stats)  # a few rows a class
    mine = F.when(F.col("label") == F.col("truth"), 1).otherwise(0)
    cand = cand.withColumn("N1", F.col("in_class") - mine).where("N1 > 0").withColumn("T1", F.col("T") - mine * F.col("len")).withColumn("V1", F.greatest(F.col("V") - F.col("only_here"), F.lit(1)))
    seen = met.where("G > o").select(*on, "instance_id", "truth", "o", F.inline("per_class"))
    c1 = F.col("C") - F.when(F.col("label") == F.col("truth"), F.col("o")).otherwise(0)
    terms = seen.groupBy(*on, "instance_id", "label").agg(F.sum(F.col("o") * F.log(c1 + SMOOTHING)).alias("s"))  # none: log 1
    met_words = (F.col("len") - F.col("alone")) * F.log(F.col("T1") + SMOOTHING * F.col("V1"))
    scored = cand.join(terms, [*on, "instance_id", "label"], "left").withColumn("score", F.round(F.log(F.col("N1") / (F.col("all") - 1)) + F.coalesce("s", F.lit(0.0)) - met_words, 9))
    return scored.groupBy(*on, "instance_id", "truth").agg(F.min(F.struct((-F.col("score")).alias("m"), "label")).alias("b")).select(*on, "instance_id", F.col("truth").alias("label"), F.col("b.label").alias("predicted"))


def leave_one_out(rows: DataFrame, fit: Callable[[pd.DataFrame], Callable[[pd.Series], str]]) -> DataFrame:
    """Prediction of each row by a classifier that ``fit`` makes of all the others: any classifier, refitted for each
    fold; a fold is a task's unit, and the (audit-sized) rows are read by all."""
    every = rows.toPandas()
    known = rows.sparkSession.sparkContext.broadcast(every)

    def folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = known.value
        for batch in batches:
            found = []
            for i in batch["instance_id"]:
                own = frame["instance_id"] == i
                found.append(fit(frame[~own])(frame[own].iloc[0]))
            yield batch.assign(predicted=found)

    ids = rows.select("instance_id", "label")
    return ids.repartition(max(8, rows.sparkSession.sparkContext.defaultParallelism)).mapInPandas(folds, ids.schema.add("predicted", "string"))


def permuted(labels: np.ndarray, permutations: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    """One row a permutation: the labels in id order, shuffled; row 0 has the true ones. The shuffles follow each other
    in one stream of numbers, so they are made where the (audit-sized) labels are."""
    rng, shuffled, out = random.Random(seed), labels.tolist(), np.empty((permutations + 1, len(labels)), labels.dtype)
    out[0] = labels
    for p in range(1, permutations + 1):
        rng.shuffle(shuffled)
        out[p] = shuffled
    return out


def _class_counts(batches: Iterator[pd.DataFrame], labels: np.ndarray, n_classes: int) -> Iterator[pd.DataFrame]:
    """Of each token, how often it stands in each class under each of these permutations of ``labels``."""
    for batch in batches:
        found = []
        for at, times in zip(batch["ds"], batch["os"]):
            own = labels[:, at]
            found.append(np.stack([(own == c) @ np.asarray(times, np.int64) for c in range(n_classes)], axis=1).astype(np.int32).tobytes())
        yield pd.DataFrame({"t": batch["t"], "counts": found})


def _right(batches: Iterator[pd.DataFrame], labels: np.ndarray, ids: np.ndarray, counts: np.ndarray, in_class: np.ndarray, totals: np.ndarray, vocabulary: int) -> Iterator[pd.DataFrame]:
    """Of these rows, how many the model of all the others gets right under each of the permutations."""
    logs, every, right = np.log(counts + SMOOTHING).reshape(len(counts), labels.shape[0] * len(in_class)), np.arange(len(labels)), np.zeros(len(labels), np.int64)
    for batch in batches:
        for d, length, lonely, ts, times in zip(batch["d"], batch["len"], batch["only_here"], batch["ts"], batch["os"]):
            truth, o, at = labels[:, d].astype(np.int64), np.asarray(times, float), np.searchsorted(ids, np.asarray(ts, np.int64))
            sums = (o @ logs[at]).reshape(len(labels), len(in_class))
            sums[every, truth] = (o[:, None] * np.log(counts[at[:, None], every, truth] - o[:, None] + SMOOTHING)).sum(axis=0)
            n, t = np.tile(in_class, (len(labels), 1)), totals.astype(float)
            n[every, truth] -= 1
            t[every, truth] -= length
            with np.errstate(divide="ignore"):
                score = np.log(n / (in_class.sum() - 1)) + sums - o.sum() * np.log(t + SMOOTHING * max(vocabulary - lonely, 1))
            right += np.round(score, 9).argmax(axis=1) == truth  # of equal ones the first label
    yield pd.DataFrame({"place": every, "right": right})


def at_once(tokens: int, classes: int) -> int:
    """How many permutations are made in one pass over the texts."""
    return max(1, CELLS // max(1, tokens * classes))


def permutation_test(rows: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """Leave-one-out accuracy, and how often shuffled labels reach it: p = (1 + as good) / (1 + permutations).

    The model is that of ``leave_one_out_bayes``. Texts are tokenised once: only the counts by class depend on the
    permutation. They are made for as many permutations at a time as ``CELLS`` counts allow, and sent to all tasks.
    """
    spark = rows.sparkSession
    order = rows.select("instance_id", "label").orderBy("instance_id").toPandas()
    classes = np.unique(order["label"].to_numpy(str))
    truth = np.searchsorted(classes, order["label"].to_numpy(str)).astype(np.min_scalar_type(len(classes)))
    shuffled, in_class = permuted(truth, permutations, seed), np.bincount(truth, minlength=len(classes))
    places = spark.createDataFrame(pd.DataFrame({"instance_id": order["instance_id"], "d": np.arange(len(order), dtype=np.int32)}))
    own = shared(token_counts(rows).join(places, "instance_id").select("d", "token", F.col("times").cast("int").alias("o")))
    by_token = own.groupBy("token").agg(F.collect_list("d").alias("ds"), F.collect_list("o").alias("os"))
    vocabulary = own.select("token").distinct().count()
    known = shared(by_token.where(F.size("ds") > 1).withColumn("t", F.monotonically_increasing_id()))
    joined = own.join(known.select("token", "t"), "token", "left")
    held = lambda x: F.collect_list(F.when(F.col("t").isNotNull(), F.col(x)))
    texts = joined.groupBy("d").agg(F.sum("o").alias("len"), F.count_if(F.col("t").isNull()).alias("only_here"), held("t").alias("ts"), held("o").alias("os"))
    nothing = {"len": F.lit(0), "only_here": F.lit(0), "ts": F.array().cast("array<long>"), "os": F.array().cast("array<int>")}
    docs = shared(places.select("d").join(texts, "d", "left").select("d", *[F.coalesce(k, v).alias(k) for k, v in nothing.items()]))
    lengths = np.zeros(len(order), np.int64)
    for r in docs.select("d", "len").toPandas().itertuples():
        lengths[r.d] = r.len
    n_known, accuracy = known.count(), []
    step = at_once(n_known, len(classes))
    for first in range(0, len(shuffled), step):
        part = shuffled[first : first + step]
        sent = spark.sparkContext.broadcast(part)
        counted = known.select("t", "ds", "os").mapInPandas(lambda b, sent=sent: _class_counts(b, sent.value, len(classes)), "t long, counts binary").toArrow().combine_chunks().sort_by("t").to_pydict()
        counts = np.frombuffer(b"".join(counted["counts"]), np.int32).reshape(-1, len(part), len(classes))
        totals = np.stack([np.bincount(x, lengths, len(classes)) for x in part])
        model = spark.sparkContext.broadcast((part, np.array(counted["t"], np.int64), counts, in_class, totals, vocabulary))
        found = docs.mapInPandas(lambda b, model=model: _right(b, *model.value), "place int, right long").groupBy("place").agg(F.sum("right").alias("right")).orderBy("place").toPandas()
        accuracy += (found["right"] / len(order)).tolist()
        sent.destroy()
        model.destroy()
    observed = F.lit(accuracy[0] if accuracy else None).cast("double").alias("observed")
    rest = spark.createDataFrame([(x,) for x in accuracy[1:]], "accuracy double").select(observed, "accuracy")
    return rest.groupBy("observed").agg(((1 + F.count_if(F.col("accuracy") >= F.col("observed"))) / (1 + F.count(F.lit(1)))).alias("p"), F.median("accuracy").alias("median"), F.max("accuracy").alias("most"))


def metadata_probe(long: DataFrame, labels: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED, depth: int = MAX_DEPTH) -> DataFrame:
    """Leave-one-out accuracy of the tree on features alone, and how often shuffled labels reach it. Each permutation is
    one run of ``leave_one_out_tree``; for audit sets of some hundred rows."""
    order = labels.select("instance_id", "label").orderBy("instance_id").toPandas()
    spark, found = labels.sparkSession, []
    for own in permuted(order["label"].to_numpy(object), permutations, seed):
        shuffled = spark.createDataFrame(pd.DataFrame({"instance_id": order["instance_id"], "label": own}))
        found.append(leave_one_out_tree(long, shuffled, depth).agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0])
    observed, rest = found[0], np.array(found[1:], float)
    row = (observed, float((1 + (rest >= observed).sum()) / (1 + len(rest))), float(np.median(rest)) if len(rest) else None, float(rest.max()) if len(rest) else None)
    return spark.createDataFrame([row], "observed double, p double, median double, most double")


def indicative_tokens(rows: DataFrame, top: int = 5, least: int = 2) -> DataFrame:
    """Words whose share of documents in a class most exceeds that elsewhere."""
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("inside")).withColumn("all", F.sum("inside").over(Window.partitionBy()))
    in_class = token_counts(rows).groupBy("label", "token").agg(F.count(F.lit(1)).alias("count"))
    total = in_class.groupBy("token").agg(F.sum("count").alias("total")).where(F.col("total") >= least)
    both = in_class.join(total, "token").join(n, "label")
    gap = F.round(F.col("count") / F.col("inside") - (F.col("total") - F.col("count")) / F.greatest(F.lit(1), F.col("all") - F.col("inside")), 9)
    order = Window.partitionBy("label").orderBy(F.desc("gap"), F.desc("token"))
    return both.withColumn("gap", gap).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("label", F.col("place").cast("long").alias("place"), "token", "count", "total", "gap")


def features(rows: DataFrame) -> DataFrame:
    """``rows(instance_id, claim, pack)`` of an input table, and ``allowed``, ``claim_type``, ``scope``, ``paper_id`` where
    it has them, to long (instance_id, name, value).

    Lengths and counts, and indicators of categories; never any text. Absent features are zero.
    """
    lengths = F.coalesce(F.nullif(F.transform("pack", lambda u: F.length(F.coalesce(u["text"], F.lit("")))), F.array().cast("array<int>")), F.array(F.lit(0)))
    name = F.col("instance_id").cast("string")
    words = F.size(F.filter(F.split(F.col("claim"), r"(?U)\s+"), lambda w: w != ""))
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    numbers = {"claim_length_chars": F.length("claim"), "claim_length_words": words, "evidence_count": F.size("pack"), "evidence_len_mean": F.round(total / F.size(lengths), 9), "evidence_len_max": F.array_max(lengths), "evidence_len_min": F.array_min(lengths), "evidence_len_total": total, "id_length": F.length(name), "id_digits": F.length(F.regexp_replace(name, "[^0-9]", ""))}
    if "allowed" in rows.columns:
        numbers["allowed_eids_count"] = F.coalesce(F.size("allowed"), F.lit(0))
    fixed = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in numbers.items()])
    one = lambda text: F.struct(text.alias("name"), F.lit(1.0).alias("value"))
    kinds = F.flatten(F.transform("pack", lambda u: F.array(one(F.concat(F.lit("modality="), u["modality"])), one(F.concat(F.lit("source_kind="), u["source_kind"])))))
    ends = F.when(F.size("pack") > 0, F.array(one(F.concat(F.lit("first_source_kind="), F.element_at("pack", 1)["source_kind"])), one(F.concat(F.lit("last_source_kind="), F.element_at("pack", -1)["source_kind"])))).otherwise(F.array().cast("array<struct<name:string,value:double>>"))
    named = [one(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None")))) for c in ("claim_type", "scope", "paper_id") if c in rows.columns]
    labels = F.array(*named) if named else F.array().cast("array<struct<name:string,value:double>>")
    long = rows.select("instance_id", F.inline(F.concat(fixed, labels, kinds, ends)))
    return long.groupBy("instance_id", "name").agg(F.sum("value").alias("value"))


def gini(counts: list[Column], n: Column) -> Column:
    out = F.lit(1.0)
    for c in counts:
        out = out - F.pow(c / n, 2)
    return out


def best_split(long: DataFrame, labels: DataFrame, classes: tuple[str, ...], min_leaf: int = MIN_LEAF) -> DataFrame:
    """The (feature, threshold) that lowers Gini impurity most; ties go to the first name, then the lowest threshold.

    Counts per (feature, value) come first; running sums then go over the distinct values of a feature. Rows without a
    feature count as zero there.
    """
    counts = [F.count_if(F.col("label") == c).alias(f"c{i}") for i, c in enumerate(classes)]
    have = long.join(labels, "instance_id").groupBy("name", "value").agg(*counts)
    everyone = labels.agg(*[c.alias(f"all{i}") for i, c in enumerate(counts)], F.count(F.lit(1)).alias("n"))
    seen = have.groupBy("name").agg(*[F.sum(f"c{i}").alias(f"s{i}") for i in range(len(classes))])
    absent = seen.join(F.broadcast(everyone)).select("name", F.lit(0.0).alias("value"), *[(F.col(f"all{i}") - F.col(f"s{i}")).alias(f"c{i}") for i in range(len(classes))])
    total = lambda p: sum((F.col(f"{p}{i}") for i in range(1, len(classes))), F.col(f"{p}0"))
    cells = have.unionByName(absent).groupBy("name", "value").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(classes))]).where(total("c") > 0)
    up_to = Window.partitionBy("name").orderBy("value")
    cum = cells.select("name", "value", F.lead("value").over(up_to).alias("next"), *[F.sum(f"c{i}").over(up_to).alias(f"l{i}") for i in range(len(classes))]).where("next IS NOT NULL").join(F.broadcast(everyone))
    left, n = total("l"), F.col("n")
    ls, rs, al = ([F.col(f"l{i}") for i in range(len(classes))], [F.col(f"all{i}") - F.col(f"l{i}") for i in range(len(classes))], [F.col(f"all{i}") for i in range(len(classes))])
    fit = cum.where((left >= min_leaf) & (n - left >= min_leaf))
    gain = F.round(gini(al, n) - (left * gini(ls, left) + (n - left) * gini(rs, n - left)) / n, 9)
    return fit.select("name", ((F.col("value") + F.col("next")) / 2).alias("threshold"), gain.alias("gain")).where("gain > 1e-12").orderBy(F.desc("gain"), "name", "threshold").limit(1)


class _Side:
    """Rows on one side of the splits so far: class counts by feature value, from which single rows can be taken off."""

    def __init__(self, features: np.ndarray, classes: np.ndarray, n_classes: int, members: np.ndarray):
        self.members, self.classes, self.totals = members, classes, np.bincount(classes[members], minlength=n_classes)
        self.cells = []
        for column in features[:, members]:
            values, place = np.unique(column, return_inverse=True)
            counts = np.zeros((len(values), n_classes), np.int64)
            np.add.at(counts, (place, classes[members]), 1)
            self.cells.append((values, np.cumsum(counts, axis=0)))

    def leaf(self, own: np.ndarray) -> int:
        """The most frequent class without the rows ``own``; of several, the one met first."""
        left = self.totals - np.bincount(self.classes[own], minlength=len(self.totals))
        tied = np.flatnonzero(left == left.max())
        if len(tied) == 1:
            return int(tied[0])
        first = lambda c: next(i for i in self.members if self.classes[i] == c and i not in own)
        return int(min(tied, key=first))

    def split(self, features: np.ndarray, own: np.ndarray) -> tuple[int, float] | None:
        """(feature, threshold) of the greatest gain without the rows ``own``. Gains that doubles cannot tell apart are
        compared as fractions; ties go to the first feature, then the lowest threshold."""
        total = self.totals - np.bincount(self.classes[own], minlength=len(self.totals))
        n = int(total.sum())
        if n < 2 * MIN_LEAF or np.count_nonzero(total) < 2:
            return None
        base = (total * total).sum() / n
        found = []
        for f, (values, cells) in enumerate(self.cells):
            low = cells.copy()
            for i in own:
                low[np.searchsorted(values, features[f, i]) :, self.classes[i]] -= 1
            size = low.sum(axis=1)
            there = np.diff(size, prepend=0) > 0
            values, low, size = values[there], low[there], size[there]
            at = np.flatnonzero((size >= MIN_LEAF) & (n - size >= MIN_LEAF))
            high = total - low[at]
            gain = ((low[at] ** 2).sum(axis=1) / size[at] + (high**2).sum(axis=1) / (n - size[at]) - base) / n
            if len(at) and gain.max() > 1e-12:
                for k in np.flatnonzero(gain >= gain.max() - 1e-12):
                    j = at[k]
                    found.append((gain[k], f, float((values[j] + values[j + 1]) / 2), low[j].tolist(), high[k].tolist()))
        if not found:
            return None
        most = max(g for g, *_ in found)
        near = [x for x in found if x[0] >= most - 1e-12]
        exact = lambda x: Fraction(sum(k * k for k in x[3]), sum(x[3])) + Fraction(sum(k * k for k in x[4]), sum(x[4]))
        best = near[0] if len(near) == 1 else max(near, key=exact)
        return best[1], best[2]


def leave_one_out_tree(long: DataFrame, labels: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Prediction of each row by a tree of all the others; a fold is a task's unit, the features are read by all.

    The tree is not fitted anew: class counts by feature value are made once for each side of a split, the fold's own
    row is taken off them, and only the side that it falls on is split further.
    """
    order = labels.select("instance_id", "label").orderBy("instance_id").toPandas()
    table = long.select("instance_id", "name", "value").toPandas()  # an audit set's features
    names, column = np.unique(table["name"].to_numpy(str), return_inverse=True)
    every = pd.Index(order["instance_id"].unique())
    place = every.get_indexer(table["instance_id"])
    values = np.zeros((len(names), len(every)))
    values[column[place >= 0], place[place >= 0]] = table["value"].to_numpy(float)[place >= 0]
    classes, kinds = pd.factorize(order["label"])
    known = labels.sparkSession.sparkContext.broadcast((every, every.get_indexer(order["instance_id"]), values, classes, list(kinds)))

    def folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every_, row_of, by_id, classes_, kinds_ = known.value
        features, sides = by_id[:, row_of], {}

        def guess(own: np.ndarray) -> str | None:
            if len(own) == len(row_of):
                return None
            path = ()
            for level in range(depth + 1):
                if path not in sides:
                    inside = np.ones(len(row_of), bool)
                    for f, threshold, low in path:
                        inside &= (features[f] <= threshold) == low
                    sides[path] = _Side(features, classes_, len(kinds_), np.flatnonzero(inside))
                best = sides[path].split(features, own) if level < depth else None
                if best is None:
                    return kinds_[sides[path].leaf(own)]
                path += ((*best, bool(features[best[0], own[0]] <= best[1])),)

        starts = np.searchsorted(row_of, np.arange(len(every_) + 1))
        for batch in batches:
            at = every_.get_indexer(batch["instance_id"])
            yield batch.assign(predicted=[guess(np.arange(starts[i], starts[i + 1])) for i in at])

    return labels.select("instance_id", "label").repartition(max(8, labels.sparkSession.sparkContext.defaultParallelism)).mapInPandas(folds, labels.select("instance_id", "label").schema.add("predicted", "string"))


def adjacent_equal(rows: DataFrame) -> DataFrame:
    """In id order, how many neighbours have the same label."""
    before = F.lag("label").over(Window.orderBy("instance_id"))
    return rows.select((F.col("label") == before).alias("same")).agg(F.count_if("same").alias("matches"), F.count(F.lit(1)).alias("n"))


def order_test(rows: DataFrame, permutations: int = ORDER_PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """matches, expected, p of the neighbours in id order against shuffled labels; one task has the audit set's labels."""

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        labels = list(frame.sort_values("instance_id")["label"])
        count = lambda x: sum(a == b for a, b in zip(x, x[1:]))
        observed, rng, found = count(labels), random.Random(seed), []
        for _ in range(permutations):
            rng.shuffle(labels)
            found.append(count(labels))
        p = (1 + sum(x >= observed for x in found)) / (1 + permutations)
        return pd.DataFrame({"matches": [observed], "expected": [sum(found) / permutations], "p": [p]})

    return rows.select(F.lit(1).alias("g"), "instance_id", "label").groupBy("g").applyInPandas(test, "matches long, expected double, p double")
