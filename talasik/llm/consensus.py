"""Consensus of several annotators' labels (problem 7).

Iteratively reweighted voting: every record's labels vote with the log-odds of their annotators'
accuracy; every annotator's accuracy is then measured against the consensus of the others on the same
records, corrected for the chance that this consensus is wrong, and smoothed. The two alternate until
no accuracy moves. An annotator's accuracy for the label said is smoothed by the annotator's own, so one
who swaps two types or always says the same is worth nothing just there. How sure a label was said to be
shifts its weight by what such labels turn out to be worth.
"""

from __future__ import annotations

import math
import warnings
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talasik.operators.skew import broadcast_if_small, skew_join
from talasik.session import cut

#: Rounds at most; a run that isn't stable by then says so. From STEADY on accuracies move by halves.
ROUNDS, STEADY = 60, 12
TOLERANCE = 1e-3
#: Pseudo-labels at the mean accuracy that smooth an annotator's own.
SMOOTHING = 8.0
#: Pseudo-labels at the annotator's accuracy that smooth the accuracy for one label said.
LABEL_SMOOTHING = 4.0
UNKNOWN = "?"
SEP = "\u0001"
#: Up to so many accuracies are sent to the executors; more are joined to the votes.
MAX_SHARED = 500_000
#: Keys a task holds before it hands their sums on.
HELD = 500_000


def tidy(column: Column) -> Column:
    """Lower case, inner white space single, none around; NULL for blanks."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(column), r"(?U)[\s\p{Z}]+", " ")), F.lit(""))


def votes_of(blotter: DataFrame, encoder_label: DataFrame) -> DataFrame:
    """record_id, annotator, label and sure (confidence word) of every label that counts.

    Of an encoder's labels in `encoder_label` the last one counts, ties going to the first by name;
    the label columns of `blotter` count once a record. NULL labels are left out first.
    """
    first = blotter.select("record_id", F.col("encoded_by").alias("annotator"), tidy(F.col("incident_type")).alias("label"), tidy(F.col("label_confidence")).alias("sure"))
    second = blotter.select("record_id", F.col("second_encoder").alias("annotator"), tidy(F.col("second_encoder_label")).alias("label"), F.lit(None).cast("string").alias("sure"))
    own = first.unionByName(second).dropDuplicates()
    later = encoder_label.select("record_id", F.col("encoder_code").alias("annotator"), tidy(F.col("incident_type")).alias("label"), tidy(F.col("label_confidence")).alias("sure"), "labelled_at").filter("label IS NOT NULL")
    last = later.groupBy("record_id", "annotator").agg(F.min_by(F.struct("label", "sure"), F.struct(-F.unix_micros(F.coalesce(F.col("labelled_at").cast("timestamp"), F.lit(0).cast("timestamp"))), F.col("label"))).alias("v"))
    last = last.select("record_id", "annotator", "v.label", "v.sure")
    every = own.unionByName(last).filter("label IS NOT NULL AND record_id IS NOT NULL")
    return every.select("record_id", F.coalesce("annotator", F.lit(UNKNOWN)).alias("annotator"), "label", F.coalesce("sure", F.lit("none")).alias("sure"))


def odds(accuracy: float, kinds: int) -> float:
    a = min(max(accuracy, 0.02), 0.98)
    return math.log(a * max(kinds - 1, 1) / (1 - a))


def scores(votes: list[tuple[str, float]]) -> dict[str, float]:
    total: dict[str, float] = defaultdict(float)
    for label, w in votes:
        total[label] += w
    return total


def leader(total: dict[str, float], kinds: int) -> tuple[str, float]:
    """The label with the largest score (ties: first by name) and its posterior among all kinds."""
    best = min(total, key=lambda x: (-total[x], x))
    rest = sum(math.exp(s - total[best]) for s in total.values()) + max(kinds - len(total), 0) * math.exp(-total[best])
    return best, 1 / rest


#: What is measured of one label beside the others of its record.
_MEASURED = "agreed double, chance double, span double"


def _compared(own: list[tuple[str, str, str, float]], kinds: int) -> Iterator[tuple[bool, float, float] | None]:
    """Of each vote (annotator, label, sure, weight): whether the others' consensus agrees, the chance of that, and what is left of 1; None without others."""
    total = scores([(label, w) for _, label, _, w in own])
    said = Counter(x[1] for x in own)
    for _, label, _, w in own:
        others = dict(total)
        others[label] -= w
        if said[label] == 1:
            del others[label]
        if not others:
            yield None
            continue
        best, sureness = leader(others, kinds)
        chance = (1 - sureness) / max(kinds - 1, 1)
        yield label == best, chance, sureness - chance


def _measure(weight, kinds: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_weight = weight()
        tally: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
        for pdf in batches:
            for votes in pdf["votes"]:
                own = [(v["annotator"], v["label"], v["sure"], own_weight(v)) for v in votes]
                for (annotator, label, sure, _), m in zip(own, _compared(own, kinds)):
                    if m is not None:
                        for key in (("annotator", annotator), ("sure", sure), ("said", annotator + SEP + label)):
                            t = tally[key]
                            for i, x in enumerate((*m, 1)):
                                t[i] += x
            if len(tally) > HELD:
                yield pd.DataFrame([(*k, *t) for k, t in tally.items()], columns=["kind", "name", "agreed", "chance", "span", "n"])
                tally.clear()
        if tally:
            yield pd.DataFrame([(*k, *t) for k, t in tally.items()], columns=["kind", "name", "agreed", "chance", "span", "n"])

    return run


class Accuracies:
    """The accuracies of one round by (kind, name): `known` while they are few enough to be sent to every executor, else a `table`."""

    def __init__(self, mean: float, known: dict[tuple[str, str], float] | None = None, table: DataFrame | None = None) -> None:
        self.mean, self.known, self.table, self.shared = mean, known or {}, table, None

    def weighed(self, records: DataFrame, kinds: int) -> tuple[DataFrame, object]:
        """`records` (record_id, votes), and what gives a vote's weight on an executor.

        Accuracies held in a table are joined to the votes, which then carry their own. Both ways give the same weights.
        """
        base = odds(self.mean, kinds)
        mean = self.mean
        if self.table is None:
            shared = self.shared = records.sparkSession.sparkContext.broadcast(self.known)

            def held():
                known = shared.value
                return lambda v: vote_weight(known.get(("said", v["annotator"] + SEP + v["label"]), known.get(("annotator", v["annotator"]), mean)), known.get(("sure", v["sure"]), mean), v["sure"], base, kinds)

            return records, held
        each = records.select("record_id", F.explode("votes").alias("v"))
        for kind, key in (("annotator", F.col("v.annotator")), ("said", F.concat("v.annotator", F.lit(SEP), "v.label")), ("sure", F.col("v.sure"))):
            side = self.table.filter(F.col("kind") == kind).select(F.col("name").alias(f"_{kind}_name"), F.col("accuracy").alias(f"_{kind}"))
            each = skew_join(each.withColumn(f"_{kind}_name", key), side, [f"_{kind}_name"], "left")
        told = F.struct("v.annotator", "v.label", "v.sure", F.coalesce("_said", "_annotator", F.lit(mean)).alias("own"), F.coalesce("_sure", F.lit(mean)).alias("how"))
        return each.groupBy("record_id").agg(F.array_sort(F.collect_list(told)).alias("votes")), lambda: lambda v: vote_weight(v["own"], v["how"], v["sure"], base, kinds)

    def drop(self) -> None:
        if self.shared is not None:
            self.shared.unpersist()


def vote_weight(own: float, how: float, sure: str, base: float, kinds: int) -> float:
    """Log-odds of the annotator's accuracy for the label, shifted by what labels so sure are worth; never against the label."""
    return max(odds(own, kinds) + (odds(how, kinds) - base if sure != "none" else 0.0), 0.0)


def _ratio(t, prior, pseudo: float) -> tuple:
    """Numerator and denominator of a smoothed accuracy; of numbers or columns."""
    return t["agreed"] - t["chance"] + pseudo * t["span"] / t["n"] * prior, t["span"] + pseudo * t["span"] / t["n"]


def _smoothed(rows: list, mean: float) -> dict[tuple[str, str], float]:
    """Accuracies by (kind, name): annotators and confidence words smoothed to the mean, labels said to their annotator's own."""
    out: dict[tuple[str, str], float] = {}
    for r in sorted(rows, key=lambda r: r["kind"]):
        said = r["kind"] == "said"
        prior = out["annotator", r["name"].split(SEP)[0]] if said else mean
        hit, known = _ratio(r, prior, LABEL_SMOOTHING if said else SMOOTHING)
        # others without any weight (a span of nothing) say nothing about an annotator
        out[r["kind"], r["name"]] = min(max(hit / known, 0.02), 0.98) if known > 1e-9 else prior
    return out


def _smoothed_table(tallies: DataFrame, mean: float) -> DataFrame:
    """As `_smoothed`, of a table: kind, name, n and accuracy."""

    def towards(prior: Column, pseudo: float) -> Column:
        hit, known = _ratio({c: F.col(c) for c in ("agreed", "chance", "span", "n")}, prior, pseudo)
        return F.when(known > 1e-9, F.least(F.greatest(hit / known, F.lit(0.02)), F.lit(0.98))).otherwise(prior)

    first = tallies.filter("kind <> 'said'").select("kind", "name", "n", towards(F.lit(mean), SMOOTHING).alias("accuracy"))
    who = first.filter("kind = 'annotator'").select(F.col("name").alias("_who"), F.col("accuracy").alias("_prior"))
    said = tallies.filter("kind = 'said'").join(who, F.substring_index("name", SEP, 1) == F.col("_who"))
    return first.unionByName(said.select("kind", "name", "n", towards(F.col("_prior"), LABEL_SMOOTHING).alias("accuracy")))


def _mean(agreed: float, chance: float, span: float) -> float:
    return min(max((agreed - chance) / max(span, 1e-9), 0.05), 0.98)


def fit(records: DataFrame, kinds: int) -> tuple[Accuracies, DataFrame, bool]:
    """Accuracies, annotators with n and accuracy, and whether they became stable. `records`: record_id, votes.

    From round STEADY on every accuracy moves half its way only, so that two consensuses that call each other forth
    meet between. A run that is not stable after ROUNDS says so in a warning.
    """
    spark = records.sparkSession
    state, stable, rated = Accuracies(0.7), False, []
    for k in range(1, ROUNDS + 1):
        votes, weight = state.weighed(records, kinds)
        tallies = votes.mapInPandas(_measure(weight, kinds), f"kind string, name string, {_MEASURED}, n double").groupBy("kind", "name").agg(*[F.sum(c).alias(c) for c in ("agreed", "chance", "span", "n")])
        if state.table is None:
            rows = tallies.limit(MAX_SHARED + 1).collect()
            mine = [r for r in rows if r["kind"] == "annotator"]
            if not rows:
                stable = True
                break
            if len(rows) <= MAX_SHARED:
                new = _smoothed(rows, mean := _mean(*(sum(r[c] for r in mine) for c in ("agreed", "chance", "span"))))
                kept = {x: (a + state.known.get(x, a)) / 2 for x, a in new.items()} if k >= STEADY else new
                moved = max(abs(a - state.known.get(x, state.mean)) for x, a in kept.items() if x[0] == "annotator")
                state.drop()
                state, rated = Accuracies(mean, kept), [(r["name"], int(r["n"]), float(kept["annotator", r["name"]])) for r in mine]
        if state.table is not None or len(rows) > MAX_SHARED:
            tallies = cut(tallies)
            whole = tallies.filter("kind = 'annotator'").agg(*[F.sum(c).alias(c) for c in ("agreed", "chance", "span")]).first()
            new = _smoothed_table(tallies, mean := _mean(*whole)).withColumn("_before", F.lit(None).cast("double"))
            if state.table is not None:
                new = new.drop("_before").join(state.table.select("kind", "name", F.col("accuracy").alias("_before")), ["kind", "name"], "left")
            kept = (F.col("accuracy") + F.coalesce("_before", "accuracy")) / 2 if k >= STEADY else F.col("accuracy")
            new = cut(new.select("kind", "name", "n", kept.alias("accuracy"), F.abs(kept - F.coalesce("_before", F.lit(state.mean))).alias("moved")))
            moved = new.filter("kind = 'annotator'").agg(F.max("moved")).first()[0]
            state.drop()
            state = Accuracies(mean, table=new)
        if moved < TOLERANCE:
            stable = True
            break
    if not stable:
        warnings.warn(f"accuracies still move after {ROUNDS} rounds", stacklevel=2)
    if state.table is not None:
        return state, state.table.filter("kind = 'annotator'").select(F.col("name").alias("annotator"), F.col("n").cast("bigint").alias("n_compared"), "accuracy"), stable
    return state, spark.createDataFrame(sorted(rated), "annotator string, n_compared bigint, accuracy double"), stable


def grouped(votes: DataFrame) -> DataFrame:
    """record_id and its votes; an encoder has one vote a record, so a record's list is bounded by the encoders."""
    return votes.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("annotator", "label", "sure"))).alias("votes"))


def consensus(votes: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_id, incident_type, n_labels, n_types, agreement, posterior) and (annotator, n_compared, accuracy).

    agreement is the share of label pairs of a record that name the same type (NULL for one label). `types` has
    type_name; a consensus outside it keeps its tidied spelling. Empty input gives empty results.
    """
    spelt = types.filter("type_name IS NOT NULL").groupBy(tidy(F.col("type_name")).alias("best")).agg(F.min("type_name").alias("type_name"))
    records = cut(grouped(votes))
    kinds = max(spelt.count(), 2)
    state, rated, _ = fit(records.filter(F.size("votes") > 1), kinds)
    rows, weight = state.weighed(records, kinds)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_weight = weight()
        for pdf in batches:
            out = []
            for rid, votes in zip(pdf["record_id"], pdf["votes"]):
                labels = [v["label"] for v in votes]
                best, sureness = leader(scores([(v["label"], own_weight(v)) for v in votes]), kinds)
                n = len(labels)
                pairs = sum(c * (c - 1) for c in Counter(labels).values())
                out.append((rid, best, n, len(set(labels)), pairs / (n * (n - 1)) if n > 1 else None, sureness))
            yield pd.DataFrame(out, columns=["record_id", "best", "n_labels", "n_types", "agreement", "posterior"])

    decided = rows.mapInPandas(decide, "record_id bigint, best string, n_labels int, n_types int, agreement double, posterior double")
    named = decided.join(broadcast_if_small(spelt), "best", "left").select("record_id", F.coalesce("type_name", "best").alias("incident_type"), "n_labels", "n_types", "agreement", "posterior")
    return named, rated


def alpha(votes: DataFrame) -> DataFrame:
    """One row: Krippendorff's nominal alpha over records with two labels or more, and their number.

    Missing ratings simply don't pair. NULL alpha when nothing can disagree.
    """
    cells = votes.groupBy("record_id", "label").agg(F.count("*").alias("n"))
    units = cells.groupBy("record_id").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).filter("m > 1")
    observed = units.agg(F.count("*").alias("records"), F.sum("m").alias("total"), F.sum(F.col("same") / (F.col("m") - 1)).alias("same"))
    marginal = cells.join(units.select("record_id"), "record_id").groupBy("label").agg(F.sum("n").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("expected"))
    total = F.col("total")
    wrong = 1 - F.col("same") / total
    chance = 1 - F.col("expected") / (total * (total - 1))
    return observed.crossJoin(marginal).select("records", F.col("total").cast("bigint").alias("labels"), F.round(F.when((total > 1) & (chance > 0), 1 - wrong / chance), 9).alias("alpha"))


def found_types(blotter: DataFrame, encoder_label: DataFrame, type_ref: DataFrame) -> DataFrame:
    """record_id and consensus type of records with three labels or more that differ."""
    decided, _ = consensus(votes_of(blotter, encoder_label), type_ref)
    return decided.filter("n_labels >= 3 AND n_types > 1").select("record_id", "incident_type")


def reliability(blotter: DataFrame, encoder_label: DataFrame, type_ref: DataFrame) -> DataFrame:
    """annotator, labels compared with others' and estimated accuracy."""
    return consensus(votes_of(blotter, encoder_label), type_ref)[1]
