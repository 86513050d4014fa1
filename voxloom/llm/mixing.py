"""Problem 9: mixing sources to target weights.

Every document has a place in [0, 2^36) by the hash of its id. Tokens are summed by source and bucket of that place; a
source's budget is met by whole rounds over the source and, for the rest, by the documents below a threshold: the bucket in
which the running sum passes the budget is found on the histogram, then only its rows are counted again in finer buckets, twice.
Documents are chosen by a filter; nothing is sorted, and thresholds for smaller budgets are nested in those for larger ones.

What a threshold leaves open is less than the document that lies on it. It is filled by thresholds of the same kind over the
later documents that still fit, until none does: at the end no document that could have another copy fits into what is left of
its source's budget, and no budget is exceeded.

The total is that of all documents of targeted sources unless it is given. A source that cannot supply its share within its
repeats supplies all it may, and the others share what is missing in proportion to their targets; the report has the shares
reached. With ``keep_shares`` the total is the largest for which every source that has documents can supply its share: one very
small source then keeps the whole mixture small, and a budget below the smallest document of its source stays empty. The report
has what each budget lacks. Targets are a table of settings, one row a source, and are planned on the driver. Defined results:
documents without id, text or tokens and documents of sources without target are left out; targets without documents get
nothing and are reported with share 0, the other shares being in proportion to their targets; repeated rows of a doc_id count
once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import frames
from voxloom.llm.tokens import TOKENIZER, token_count
from voxloom.plans.shared import materialize

BITS, LEVELS = 12, 3
PLACES = 1 << BITS * LEVELS
ONE_TASK = 1_000_000  # rows
MOST_TOKENS = 1 << 62
NEAR = 64  # how many times what is open the first stretch searched for fillers is expected to hold


def weighed(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, place) of the documents of targeted sources, once each."""
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source").distinct()
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "source", "text").join(wanted, "source", "left_semi")
    counted = rows.select("doc_id", "source", token_count("text", tokenizer).alias("tokens"))
    once = counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("d")).select("doc_id", "d.source", "d.tokens")
    return once.where("tokens > 0").withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - BITS * LEVELS))


def fill(rows: list[dict], total_tokens: float) -> None:
    """Budgets in proportion to the shares; what a source cannot supply within its repeats goes to the others in proportion.

    Sources are served in the order in which they run out, so one pass does.
    """
    left, weight = total_tokens, sum(r["share"] for r in rows if r["available"])
    for r in sorted(rows, key=lambda r: r["repeats"] * r["available"] / r["share"]):
        r["budget"] = 0
        if r["available"]:
            r["budget"] = max(0, int(min(round(left * r["share"] / weight), r["repeats"] * r["available"])))
            left, weight = left - r["budget"], weight - r["share"]


def thresholds(rows: DataFrame, asked: dict[str, tuple[int, int, int, int]], steps: tuple[int, ...]) -> dict[str, tuple[int, int, bool]]:
    """source -> (threshold, tokens below it, whether all of the stretch fits).

    ``asked``: by source a stretch of places (from, to), the tokens wanted of it and the most a document may have. ``steps``: the
    widths of buckets, each counted inside the bucket found before.
    """
    out, state = {}, {s: (lo, hi, want, most, 0) for s, (lo, hi, want, most) in asked.items()}
    for width in steps:
        if not state:
            break
        frame = rows.sparkSession.createDataFrame([(s, *v) for s, v in state.items()], "source string, low long, high long, rest long, most long, used long")
        inside = rows.join(F.broadcast(frame), "source").where("place >= low and place < high and tokens <= most")
        histogram = inside.groupBy("source", "rest", F.floor((F.col("place") - F.col("low")) / width).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
        sums = histogram.withColumn("upto", upto)
        found = {r["source"]: r for r in sums.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before")))).alias("b"), F.max("upto").alias("all")).collect()}
        for s, (lo, hi, rest, most, used) in list(state.items()):
            r = found.get(s)
            if r is None or r["b"] is None:
                out[s] = (hi, used + (r["all"] if r else 0), True)
                del state[s]
            else:
                lo += r["b"]["bucket"] * width
                state[s] = (lo, min(hi, lo + width), rest - r["b"]["before"], most, used + r["b"]["before"])
    return out | {s: (lo, used, False) for s, (lo, _, _, _, used) in state.items()}


def plan(weights: DataFrame, targets: DataFrame, total_tokens: int | None = None, keep_shares: bool = False) -> list[dict]:
    """One dict a target: source, share, repeats, available, budget, rounds, threshold, fills (from, to, most tokens)."""
    stated = [r.asDict() for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").collect()]
    have = {r["source"]: r["tokens"] for r in weights.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    supplied = sum(t["target_share"] for t in stated if have.get(t["source"]))
    rows = [dict(source=t["source"], share=t["target_share"], repeats=t["max_repeats"], available=have.get(t["source"], 0)) for t in stated]
    if keep_shares:
        total_tokens = min((r["repeats"] * r["available"] * supplied / r["share"] for r in rows if r["available"]), default=0)
    elif total_tokens is None:
        total_tokens = sum(r["available"] for r in rows)
    fill(rows, total_tokens)
    for r in rows:
        r["rounds"] = r["budget"] // r["available"] if r["available"] else 0
        r["gap"] = r["budget"] - r["rounds"] * r["available"]
        r["threshold"], r["fills"] = 0, []
    by = {r["source"]: r for r in rows if r["gap"] > 0}
    steps = tuple(1 << BITS * k for k in reversed(range(LEVELS)))
    for s, (at, used, _) in thresholds(weights, {s: (0, PLACES, r["gap"], MOST_TOKENS) for s, r in by.items()}, steps).items() if by else ():
        by[s]["threshold"], by[s]["gap"] = at, by[s]["gap"] - used
    _fill_gaps(weights, by)
    return rows


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The fillers of a short stretch (source, place, tokens, low, gap) in one go: documents in order of place, each that still fits."""
    rows = pd.concat([*batches, pd.DataFrame({"source": [], "place": [], "tokens": [], "low": [], "gap": []})])
    out = []
    for source, mine in rows.groupby("source", sort=False):
        gap = most = int(mine["gap"].iloc[0])
        low, used = int(mine["low"].iloc[0]), 0
        for place, here in mine.sort_values("place").groupby("place"):
            sizes, place = here["tokens"].astype("int64"), int(place)
            want = int(sizes[sizes <= most].sum())
            if want > gap:  # a new threshold begins here, for documents that fit into what is open now
                if used:
                    out.append((source, low, place, most, used))
                low, most, used = place, gap, 0
                want = int(sizes[sizes <= most].sum())
                if want > gap:
                    low, want = place + 1, 0
            gap, used = gap - want, used + want
        if used:
            out.append((source, low, int(mine["place"].max()) + 1, most, used))
    yield frames.frame(["source", "low", "high", "most", "used"], out)


def _fill_gaps(weights: DataFrame, by: dict[str, dict]) -> None:
    """Thresholds over later documents that fit into what is open of a budget, stretch by stretch.

    A stretch is written out once and is small: what is open is less than one document, and the stretch is as long as holds a
    multiple of it. Stretches grow until all places are searched. One of at most ONE_TASK rows is searched in one task, a longer
    one by a histogram for each threshold; the outcome is the same.
    """
    begin, factor = {s: r["threshold"] for s, r in by.items() if r["gap"] > 0}, NEAR
    while begin := {s: at for s, at in begin.items() if at < PLACES and by[s]["gap"] > 0}:
        end = {s: min(PLACES, at + 1 + factor * PLACES * by[s]["gap"] // by[s]["available"]) for s, at in begin.items()}
        frame = weights.sparkSession.createDataFrame([(s, at, end[s], by[s]["gap"]) for s, at in begin.items()], "source string, low long, high long, most long")
        near = weights.join(F.broadcast(frame), "source").where("place >= low and place < high and tokens <= most").select("source", "place", "tokens")
        near = materialize(near, "near")
        open_at = dict(begin)
        if near.count() <= ONE_TASK:
            for r in near.join(F.broadcast(frame.select("source", "low", F.col("most").alias("gap"))), "source").coalesce(1).mapInPandas(_greedy, "source string, low long, high long, most long, used long").collect():
                by[r["source"]]["fills"].append((r["low"], r["high"], r["most"]))
                by[r["source"]]["gap"] -= r["used"]
            open_at = {}
        while open_at:
            for s, (at, used, all_fit) in thresholds(near, {s: (at, end[s], by[s]["gap"], by[s]["gap"]) for s, at in open_at.items()}, (1,)).items():
                if used:
                    by[s]["fills"].append((open_at[s], at, by[s]["gap"]))
                    by[s]["gap"] -= used
                open_at[s] = at
                if all_fit or by[s]["gap"] <= 0:
                    del open_at[s]
                elif not used:  # the place found holds more than fits although each document would: go past it
                    open_at[s] = at + 1
        begin, factor = end, factor * 16


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, keep_shares: bool = False, tokenizer: str = TOKENIZER, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(chosen, report): (doc_id, source, tokens, copies), and by target the shares reached."""
    return choose(materialize(weighed(documents, targets, tokenizer, seed), "weights"), targets, total_tokens, keep_shares)


def choose(weights: DataFrame, targets: DataFrame, total_tokens: int | None = None, keep_shares: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = plan(weights, targets, total_tokens, keep_shares)
    schema = "source string, target_share double, max_repeats int, available_tokens long, budget_tokens long, rounds long, threshold long, fills array<struct<low:long,high:long,most:long>>"
    budgets = weights.sparkSession.createDataFrame([tuple(r[k] for k in ("source", "share", "repeats", "available", "budget", "rounds", "threshold", "fills")) for r in rows], schema)
    filler = F.exists("fills", lambda f: (F.col("place") >= f["low"]) & (F.col("place") < f["high"]) & (F.col("tokens") <= f["most"]))
    once_more = (F.col("place") < F.col("threshold")) | filler
    chosen = (
        weights.join(F.broadcast(budgets.select("source", "rounds", "threshold", "fills")), "source")
        .withColumn("copies", (F.col("rounds") + once_more.cast("long")).cast("int"))
        .where("copies > 0").select("doc_id", "source", "tokens", "copies")
    )
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = used.agg(F.sum("tokens").alias("total_tokens"))
    report = budgets.drop("rounds", "threshold", "fills").join(used, "source", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = report.select("source", "target_share", "max_repeats", "available_tokens", "budget_tokens", zero("tokens"), zero("documents"), zero("most_copies"), F.coalesce(F.col("tokens") / F.col("total_tokens"), F.lit(0.0)).alias("share"))
    return chosen, report.withColumn("lacking_tokens", F.col("budget_tokens") - F.col("tokens"))


def checks(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 0) -> DataFrame:
    """(source, within_repeats, within_budget, filled): what a mixture promises of every target with a share, counted on its rows.

    ``filled``: no document that may have another copy fits into what is left of the budget.
    """
    weights = materialize(weighed(documents, targets, tokenizer, seed), "weights")
    chosen, report = choose(weights, targets)
    could = weights.join(chosen.select("doc_id", "copies"), "doc_id", "left").join(F.broadcast(targets.select("source", "max_repeats")), "source")
    fewest = could.groupBy("source").agg(F.min(F.coalesce("copies", F.lit(0))).alias("fewest"))
    free = could.join(F.broadcast(fewest), "source").where((F.coalesce("copies", F.lit(0)) == F.col("fewest")) & (F.coalesce("copies", F.lit(0)) < F.col("max_repeats"))).groupBy("source").agg(F.min("tokens").alias("smallest"))
    rows = report.join(free, "source", "left")
    return rows.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), (F.col("tokens") <= F.col("budget_tokens")).alias("within_budget"), F.coalesce(F.col("lacking_tokens") < F.col("smallest"), F.col("tokens") == F.col("budget_tokens")).alias("filled"))


def copies_as_rows(chosen: DataFrame, documents: DataFrame) -> DataFrame:
    """The mixture itself: the chosen documents with all their columns, one row a copy, numbered in ``_mix_copy``."""
    once = documents.join(chosen.select("doc_id", F.col("copies").alias("_mix_copies")), "doc_id")
    return once.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), "_mix_copies"))).drop("_mix_copies")


__all__ = ["checks", "choose", "copies_as_rows", "mixed", "plan", "weighed"]
