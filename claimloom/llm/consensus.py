"""Problem 6: consensus labels, agreement, and the reliability of annotators.

Method: triplet moments. For each label, two annotators' votes for it co-vary by v * d_i * d_j, where v is the variance of the
label itself and d the annotator's discrimination, P(vote for it | it is true) - P(vote for it | it is not). Subtracting each
annotator's own rate from its votes is the correction for chance, so annotators who favour a label gain nothing by agreeing. An
annotator and two others give d_i squared = c_ij * c_ik / c_jk; all triplets of an annotator are pooled in a closed form, over the
fields too. A first solution takes all partners alike, the second and last weighs them by what the first found them to be worth.
The share p of a label comes from triplets as well: the third moment of three annotators' votes by the second to the power 3/2
is (1 - 2p) / sqrt(p(1 - p)). The votes are then combined once, by the log-odds of the rates so found. Nothing is re-estimated
from labels so combined.

Of an item with votes z (less their rates), sum S, squares' sum Q and cubes' sum C, the sum over all pairs is S^2 - Q, that over
all triples S^3 - 3SQ + 2C, and that over all pairs without one vote follows from S and Q without it. So no pair is ever made, the
work is in proportion to the votes, and any number of annotators is solved for where the votes lie; the driver sees a few sums a
field. Items are summed in buckets of about ``hot_votes`` votes; items with more votes, found by exact counts, in two levels by a salt.

Labels are compared trimmed, regardless of case and of a final period; "y" and "n" are yes and no, "?" is unclear; anything else
is no label. Of one annotator's decisions on an item the latest counts (then the one with the larger decision_id), also if it
has no label in a field. Nulls for item or annotator leave a decision out. Items without a label in a field yield no row for it.
Equally likely labels go to the first of yes, no, unclear. Empty tables yield no row; deliveries repeated change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.session import bounded, written

LABELS = ("yes", "no", "unclear")
FIELDS = ("subject_correct", "direction_correct", "snippet_supports_claim")
#: Ways to write the labels. Fixed values.
WRITTEN = {"yes": "yes", "y": "yes", "true": "yes", "no": "no", "n": "no", "false": "no", "unclear": "unclear", "?": "unclear", "unsure": "unclear", "unknown": "unclear"}

K = range(len(LABELS))
#: Votes that an annotator's solution must outweigh: those of the mean annotator, and those of all triplets together.
MEAN_VOTES, ALL_TRIPLETS = 10.0, 50.0
MOST_FIELDS = 1_000


def label(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\"']+|[\s\p{Z}\"'.]+$", ""))
    return F.create_map(*[F.lit(x) for kv in WRITTEN.items() for x in kv])[bare]


def decisions(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``item``, ``who``, ``field``, ``vote``: the labels of each annotator's latest decision on each item."""
    last = Window.partitionBy("item", "who").orderBy(F.col("decided_at").desc_nulls_last(), F.col("decision_id").desc_nulls_last())
    rows = df.select(F.col("audit_id").alias("item"), F.trim("reviewer_id").alias("who"), "decided_at", "decision_id", *[label(F.col(f)).alias(f) for f in fields]).where("item is not null and who is not null and who <> ''")
    rows = rows.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    pairs = ", ".join(f"'{f}', {f}" for f in fields)
    return rows.select("item", "who", F.expr(f"stack({len(fields)}, {pairs}) as (field, vote)")).where("vote is not null")


PARTS = 1 + 8 * len(LABELS)
MOMENTS = (*(f"{c}{x}" for c in ("num", "cnt", "pair", "pcn", "m2_", "c2_", "m3_", "c3_") for x in K), "alike", "both", "chance")
_ITEM, _WHO = ("item", "field"), ("who", "field")


def _codes(t: pa.Table | pa.RecordBatch, names: tuple[str, ...]) -> tuple[np.ndarray, pa.Table]:
    """The number of each row's group, and one row a group."""
    code = np.zeros(t.num_rows, "i8")
    for n in names:
        words = pa.chunked_array([t.column(n)]) if isinstance(t, pa.RecordBatch) else t.column(n)
        words = words.combine_chunks().dictionary_encode()
        code = code * (len(words.dictionary) + 1) + words.indices.to_numpy()
    _, first, at = np.unique(code, return_index=True, return_inverse=True)
    return at, pa.table({n: t.column(n).take(pa.array(first)) for n in names})


def _total(at: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(at, c, n) for c in values.T], 1) if len(at) else np.zeros((n, values.shape[1]))


def _parts(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    """What each vote adds to the sums of its item: 1, and label by label the weighted vote, its square and cube, the weight, its square and cube, the vote less its rate, and the rate."""
    col = lambda c: np.stack([t.column(f"{c}{x}").to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(f"{c}{x}").to_numpy() for x in K], 1).astype("f8")
    r, u, vote = col("r"), col("u"), np.asarray(t.column("vote"))
    z = (vote[:, None] == np.arange(len(LABELS))[None]) - r
    w, a = z * u, u * u
    return np.concatenate([np.ones((len(vote), 1)), w, w**2, w**3, a, a**2, a**3, z, r], 1)


def _moments_of(own: np.ndarray, item: np.ndarray, vote: np.ndarray) -> np.ndarray:
    """Each vote's moments, from its own parts and the sums of its item."""
    k = len(LABELS)
    n, (s, q, c, u, v, w, sz, sr) = item[:, :1], np.split(item[:, 1:], 8, 1)
    _, (t, t2, _, a, a2, _, z, r) = own[:, :1], np.split(own[:, 1:], 8, 1)
    so, qo, uo, vo = s - t, q - t2, u - a, v - a2
    alike = np.take_along_axis(sz + sr, vote[:, None].astype(int), 1) - 1
    return np.concatenate([z * so, uo, so * so - qo, uo * uo - vo, (s * s - q) / n, (u * u - v) / n, (s**3 - 3 * s * q + 2 * c) / n, (u**3 - 3 * u * v + 2 * w) / n, alike, n - 1, (r * (sr - r)).sum(1, keepdims=True)], 1)[:, : 8 * k + 3]


def _by_annotator(t: pa.Table | pa.RecordBatch, moments: np.ndarray) -> pa.Table:
    at, keys = _codes(t, _WHO)
    total = _total(at, keys.num_rows, moments)
    return pa.table([*keys.columns, *(pa.array(c) for c in total.T)], names=[*_WHO, *MOMENTS])


def _moments(votes: DataFrame, hot: DataFrame | None, worth: DataFrame, buckets: int, salts: int = 64) -> DataFrame:
    """By annotator and field, label by label: the moments with one partner (``num``, ``cnt``) and of all pairs of partners (``pair``, ``pcn``), its part in the moments of all pairs and triples (``m2_``, ``c2_``, ``m3_``, ``c3_``), and what it agreed on (``alike``, ``both``, ``chance``).

    ``worth`` holds, by annotator and field, the rates ``r`` of its votes and the weights ``u`` of its partnership. A bucket holds
    whole items; what leaves it is one row an annotator and field in it.
    """
    code = F.array_position(F.array(*map(F.lit, LABELS)), F.col("vote")).cast("tinyint") - F.lit(1).cast("tinyint")
    rows = votes.join(worth.select(*_WHO, *[F.col(f"{c}{x}").cast("float").alias(f"{c}{x}") for c in "ru" for x in K]), list(_WHO)).withColumn("vote", code)
    schema = "who string, field string, " + ", ".join(f"{m} double" for m in MOMENTS)

    def cold(t: pa.Table) -> pa.Table:
        at, keys = _codes(t, _ITEM)
        own = _parts(t)
        return _by_annotator(t, _moments_of(own, _total(at, keys.num_rows, own)[at], t.column("vote").to_numpy()))

    calm = rows if hot is None else rows.join(hot, list(_ITEM), "left_anti")
    out = calm.withColumn("bucket", F.pmod(F.xxhash64(*_ITEM), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(cold, schema)
    if hot is not None:
        sums = [f"p{i}" for i in range(PARTS)]

        def level_one(t: pa.Table) -> pa.Table:
            total = _parts(t).sum(0)
            return pa.table([t.column("item")[:1], t.column("field")[:1], *(pa.array([x]) for x in total)], names=[*_ITEM, *sums])

        def level_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                if t.num_rows:
                    item = np.stack([t.column(c).to_numpy(zero_copy_only=False) for c in sums], 1)
                    yield from _by_annotator(t, _moments_of(_parts(t), item, np.asarray(t.column("vote")))).combine_chunks().to_batches()

        warm = rows.join(hot, list(_ITEM), "left_semi")
        part = warm.withColumn("salt", F.pmod(F.xxhash64("who"), F.lit(salts))).groupBy(*_ITEM, "salt").applyInArrow(level_one, "item string, field string, " + ", ".join(f"{c} double" for c in sums))
        total = part.groupBy(*_ITEM).agg(*[F.sum(c).alias(c) for c in sums])
        out = out.unionByName(warm.join(total, list(_ITEM)).mapInArrow(level_two, schema))
    return out.groupBy(*_WHO).agg(*[F.sum(m).alias(m) for m in MOMENTS])


def share_by_triples(m2: float, m3: float) -> float:
    """The share of a label from the second and third moments of its votes."""
    s = m3 / max(m2, 1e-6) ** 1.5
    return min(max((1 - s / math.sqrt(4 + s * s)) / 2, 0.01), 0.98)


def _shares(moments: DataFrame, habits: DataFrame) -> dict[str, list[float]]:
    """The share of each label in each field; where no item has three votes, that of the votes."""
    cols = [f"{c}{x}" for c in ("m2_", "c2_", "m3_", "c3_") for x in K]
    each = moments.groupBy("field").agg(*[F.sum(c).alias(c) for c in cols])
    cast = habits.groupBy("field").agg(*[F.sum(f"n{x}").alias(f"n{x}") for x in K])
    out = {}
    for r in bounded(cast.join(each, "field", "left"), MOST_FIELDS, "fields"):
        raw = [r[f"n{x}"] / max(sum(r[f"n{y}"] for y in K), 1) for x in K]
        # a difference of large sums: what should be no triple at all may be a rounding error
        p = [share_by_triples(r[f"m2_{x}"] / r[f"c2_{x}"], r[f"m3_{x}"] / r[f"c3_{x}"]) if r[f"c3_{x}"] and r[f"c3_{x}"] > 1e-3 else min(max(raw[x], 0.01), 0.98) for x in K]
        out[r["field"]] = [y / sum(p) for y in p]
    return out


def _by_field(shares: dict[str, list[float]], f) -> Column:
    """A number for each field."""
    out = None
    for name, share in shares.items():
        out = (F if out is None else out).when(F.col("field") == name, F.lit(float(f(share))))
    return F.lit(0.0) if out is None else out.otherwise(0.0)


def _discriminations(moments: DataFrame, habits: DataFrame, shares: dict[str, list[float]]) -> DataFrame:
    """``who`` and ``d`` by label: the closed form of its triplets, pooled over the fields and drawn a little to the mean annotator."""
    var = [_by_field(shares, lambda p, x=x: max(p[x] * (1 - p[x]), 0.02)) for x in K]
    pooled = moments.groupBy("who").agg(*[F.sum(F.col(f"{c}{x}") / (var[x] if c in ("num", "pair") else F.lit(1.0))).alias(f"{c}{x}") for c in ("num", "cnt", "pair", "pcn") for x in K])
    pooled = written(pooled.join(habits.groupBy("who").agg(F.sum("n").alias("n")), "who"), "annotator-moments")
    every = pooled.agg(*[F.try_divide(F.sum(f"pair{x}"), F.sum(f"pcn{x}")).alias(f"e{x}") for x in K]).first()
    d = []
    for x in K:
        e = max(every[f"e{x}"] or 0.0, 1e-3)
        low = (F.col(f"pair{x}") + ALL_TRIPLETS * e) / (F.col(f"pcn{x}") + ALL_TRIPLETS)
        d.append(F.coalesce(F.try_divide(F.col(f"num{x}"), F.col(f"cnt{x}")), F.lit(0.0)) / F.sqrt(F.greatest(low, F.lit(1e-3))))
    raw = pooled.select("who", "n", *[d[x].alias(f"d{x}") for x in K])
    mean = raw.agg(*[F.try_divide(F.sum(F.col(f"d{x}") * F.col("n")), F.sum("n")).alias(f"d{x}") for x in K]).first()
    drawn = lambda x: (F.col("n") * F.col(f"d{x}") + MEAN_VOTES * (mean[f"d{x}"] or 0.5)) / (F.col("n") + MEAN_VOTES)
    return raw.select("who", *[F.greatest(F.least(drawn(x), F.lit(0.98)), F.lit(-0.98)).alias(f"d{x}") for x in K])


def _rates(habits: DataFrame, d: DataFrame, shares: dict[str, list[float]]) -> DataFrame:
    """``who``, ``field``, ``p``: P(vote | label) as an array, label by label, from the discriminations: what is left after the label itself is spread by the annotator's own habits."""
    share = [_by_field(shares, lambda p, x=x: p[x]) for x in K]
    rows = habits.join(d, "who")
    rows = rows.select("who", "field", "n", *[f"n{x}" for x in K], *[f"d{x}" for x in K], *[share[x].alias(f"s{x}") for x in K])
    habit = [(F.col(f"n{x}") + 2 * F.col(f"s{x}")) / (F.col("n") + 2) for x in K]
    between = lambda c, low: F.greatest(F.least(c, F.lit(0.98)), F.lit(low))
    rows = rows.withColumns({f"hit{x}": between(habit[x] + (1 - F.col(f"s{x}")) * F.col(f"d{x}"), 0.02) for x in K} | {f"miss{x}": between(habit[x] - F.col(f"s{x}") * F.col(f"d{x}"), 0.01) for x in K})
    p = []
    for t in K:
        row = [F.col(f"hit{x}" if x == t else f"miss{x}") for x in K]
        p += [y / sum(row[1:], row[0]) for y in row]
    return rows.select("who", "field", "n", F.array(*p).alias("p"))


def _learn(df: DataFrame, hot_votes: int) -> tuple[DataFrame, DataFrame | None, DataFrame, dict[str, list[float]], DataFrame]:
    """Votes, their hot items, P(vote | label) by annotator and field, the labels' shares, and the first moments."""
    votes = written(decisions(df), "latest-votes")
    hot = written(votes.groupBy(*_ITEM).count().where(F.col("count") > hot_votes).select(*_ITEM), "hot-items")
    hot = None if hot.isEmpty() else hot
    count = [F.count_if(F.col("vote") == LABELS[x]).alias(f"n{x}") for x in K]
    habits = written(votes.groupBy(*_WHO).agg(F.count("*").alias("n"), *count), "annotators-habits")
    buckets = max(1, -(-(habits.agg(F.sum("n")).first()[0] or 0) // hot_votes))
    rated = habits.select(*_WHO, *[(F.col(f"n{x}") / F.col("n")).alias(f"r{x}") for x in K])
    first = written(_moments(votes, hot, rated.withColumns({f"u{x}": F.lit(1.0) for x in K}), buckets), "moments")
    shares = _shares(first, habits)
    d = _discriminations(first, habits, shares)
    second = written(_moments(votes, hot, rated.join(d.withColumnsRenamed({f"d{x}": f"u{x}" for x in K}), "who"), buckets), "weighted-moments")
    shares = _shares(second, habits)
    p = written(_rates(habits, _discriminations(second, habits, shares), shares), "annotators-rates")
    return votes, hot, p, shares, first


def labelled(df: DataFrame, *, hot_votes: int = 50_000, salts: int = 64) -> DataFrame:
    """``item``, ``field``, ``label``, its posterior ``certainty``, the votes' number and ``agreement``: the share of the item's pairs of votes that agree."""
    votes, hot, p, shares, _ = _learn(df, hot_votes)
    at = F.array_position(F.array(*map(F.lit, LABELS)), F.col("vote")).cast("int") - 1
    rows = votes.join(p.select("who", "field", "p"), ["who", "field"]).select("item", "field", "who", "vote", *[F.log(F.col("p")[at + t * len(LABELS)]).alias(f"l{t}") for t in K])
    sums = [*[F.sum(f"l{t}").alias(f"l{t}") for t in K], *[F.sum(f"n{x}").alias(f"n{x}") for x in K]]
    rows = rows.select("*", *[F.when(F.col("vote") == LABELS[x], 1).otherwise(0).alias(f"n{x}") for x in K])
    key = ["item", "field"]
    cold = rows if hot is None else rows.join(hot, key, "left_anti")
    each = cold.groupBy(*key).agg(*sums)
    if hot is not None:
        warm = rows.join(hot, key, "left_semi").groupBy(*key, F.pmod(F.xxhash64("who"), F.lit(salts)).alias("_salt")).agg(*sums)
        each = each.unionByName(warm.groupBy(*key).agg(*sums))
    score = F.array(*[F.round(F.col(f"l{t}") + _by_field(shares, lambda s, t=t: math.log(s[t])), 9) for t in K])
    n = F.col("n0") + F.col("n1") + F.col("n2")
    out = each.select(*key, score.alias("score"), n.alias("n"), sum((F.col(f"n{x}") * (F.col(f"n{x}") - 1) for x in K), F.lit(0)).alias("same"))
    best = F.array_max("score")
    sure = F.lit(1.0) / F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - F.array_max("score")))
    return out.select(
        *key, F.element_at(F.array(*map(F.lit, LABELS)), F.array_position("score", best).cast("int")).alias("label"), sure.alias("certainty"), F.col("n").cast("int").alias("n_votes"),
        F.when(F.col("n") > 1, F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("agreement"),
    )


def found(df: DataFrame) -> DataFrame:
    return labelled(df).select(F.col("item").alias("audit_id"), "field", "label")


def reviewers(df: DataFrame, *, hot_votes: int = 50_000) -> DataFrame:
    """``field``, ``who``, labels given, ``reliability`` (expected share of right votes) and ``agreement`` with others, corrected for the chance that both annotators' own rates give."""
    _, _, p, shares, first = _learn(df, hot_votes)
    right = sum((F.col("p")[x * len(LABELS) + x] * _by_field(shares, lambda s, x=x: s[x]) for x in K), F.lit(0.0))
    kappa = F.when(F.col("both") - F.col("chance") > 1e-9, (F.col("alike") - F.col("chance")) / (F.col("both") - F.col("chance")))
    return p.join(first.select("who", "field", "alike", "both", "chance"), ["who", "field"]).select("field", "who", F.col("n").alias("n_labels"), right.alias("reliability"), kappa.alias("agreement"))
