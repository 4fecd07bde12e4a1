"""Mixing sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.skew import lookup
from weftline.session import written

#: Membership patterns (own source, other sources with the same text) times sources that the flow is solved over, a
#: table of so many cells on the driver; more are an error. At this size it took 4 s with 20 sources and 48 s with 200.
MAX_CELLS = 2_000_000
FAR = 1 << 60


def _first_of(amounts: np.ndarray, total: int) -> np.ndarray:
    """Of each amount, what the first ``total`` in all take."""
    upto = np.cumsum(amounts)
    return np.clip(total - (upto - amounts), 0, amounts)


def _least_cost(own: np.ndarray, tokens: np.ndarray, room: np.ndarray, quota: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Tokens of each class (rows) that go to each source: as many as fit, at least cost.

    ``own`` is the column of a class's own source, ``room`` what may go from a
    class to a source, ``quota`` what a source takes, ``repeats`` how often a
    class may appear. The k-th appearance costs 2 k squared, and another source
    than the own one more. Successive shortest paths, with all classes that
    would be on equal paths at once: a path enters one source and may lead on
    to others by moving what classes have there, so it is found among sources
    alone, and how many paths there are depends on sources and repeats.
    """
    n, m = room.shape
    rows = np.arange(n)
    other = np.ones((n, m), np.int64)
    other[rows, own] = 0
    is_own = other == 0
    flow, quota = np.zeros((n, m), np.int64), quota.copy()
    used = np.zeros(n, np.int64)
    while quota.any():
        level = used // np.maximum(tokens, 1)
        entry = np.where((level < repeats) & (tokens > 0), 2 * (level + 1) ** 2, FAR)
        left = np.where(entry < FAR, tokens - used % np.maximum(tokens, 1), 0)
        free, held = flow < room, flow > 0
        begin = np.where(free & (entry < FAR)[:, None], entry[:, None] + other, FAR)
        dist, came = begin.min(axis=0, initial=FAR), np.full(m, -1)
        # What it costs to move a token of some class from one source to another: -1 to its own, 1 away from it, else 0.
        can = lambda a, b: (a.T.astype(np.float32) @ b.astype(np.float32)) > 0
        move = np.where(can(held & ~is_own, free & is_own), -1, np.where(can(held & ~is_own, free & ~is_own), 0, np.where(can(held & is_own, free & ~is_own), 1, FAR)))
        for _ in range(m):
            through = np.where(dist[:, None] < FAR, dist[:, None] + move, FAR)
            nearest = through.argmin(axis=0)
            better = through[nearest, np.arange(m)] < dist
            if not better.any():
                break
            dist = np.where(better, through[nearest, np.arange(m)], dist)
            came = np.where(better, nearest, came)
        ends = np.flatnonzero((quota > 0) & (dist < FAR))
        if not len(ends):
            break
        path = [int(ends[np.argmin(dist[ends])])]
        while came[path[-1]] >= 0:
            path.append(int(came[path[-1]]))
        first = path[-1]
        enters = np.where(begin[:, first] == begin[:, first].min(), np.minimum(left, room[:, first] - flow[:, first]), 0)
        moves = []
        for to, start in zip(path, path[1:], strict=False):
            fit = (other[:, to] - other[:, start] == move[start, to]) & held[:, start] & free[:, to]
            moves.append((start, to, np.where(fit, np.minimum(flow[:, start], room[:, to] - flow[:, to]), 0)))
        amount = int(min([quota[path[0]], enters.sum(), *(x.sum() for _, _, x in moves)]))
        for start, to, most in moves:
            part = _first_of(most, amount)
            flow[:, start] -= part
            flow[:, to] += part
        part = _first_of(enters, amount)
        flow[:, first] += part
        used += part
        quota[path[0]] -= amount
    return flow


def route(classes: list[tuple[int, str, list[str], int]], targets: dict[str, tuple[float, int]], size: int) -> tuple[dict[tuple[int, str], int], dict[str, int]]:
    """Tokens of each class that go to each source, and each source's quota.

    ``classes`` are (number, own source, sources that hold the same texts,
    tokens); ``targets`` are (weight, most repeats) of each source. The k-th
    appearance of a document costs k squared, so no document appears again
    while others of its class don't appear at all, and one unit more if it
    stands for another source than its own. A source that can't fill its quota
    keeps what it can; the rest goes to the others by their weights.
    """
    names = sorted(targets)
    at = {s: i for i, s in enumerate(names)}
    if len(classes) * len(names) > MAX_CELLS:
        raise ValueError(f"{len(classes)} membership patterns of {len(names)} sources: more than {MAX_CELLS} cells")
    own = np.array([at[c[1]] for c in classes], np.int64)
    tokens = np.array([c[3] for c in classes], np.int64)
    most = np.array([targets[s][1] for s in names], np.int64)
    repeats = most[own] if len(classes) else own
    room = np.zeros((len(classes), len(names)), np.int64)
    for i, (_, source, members, size_) in enumerate(classes):
        for s in {source, *members} & at.keys():
            room[i, at[s]] = size_ * min(repeats[i], most[at[s]])
    weight = {s: max(0.0, targets[s][0]) for s in names}
    open_sources, fixed = {s for s in names if weight[s] > 0}, {}
    while True:
        left, whole = size - sum(fixed.values()), sum(weight[s] for s in sorted(open_sources))
        exact = {s: left * weight[s] / whole for s in sorted(open_sources)} if whole > 0 else {}
        quota = dict.fromkeys(names, 0) | fixed | {s: int(x) for s, x in exact.items()}
        for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, left - sum(quota[s] for s in exact))]:
            quota[s] += 1
        flow = _least_cost(own, tokens, room, np.array([quota[s] for s in names], np.int64), repeats)
        got = dict(zip(names, flow.sum(axis=0).tolist(), strict=True))
        short = {s: got[s] for s in open_sources if got[s] < quota[s]}
        if not short:
            return {(classes[i][0], names[j]): int(flow[i, j]) for i, j in zip(*np.nonzero(flow), strict=True)}, quota
        fixed |= short
        open_sources -= set(short)


def mix(documents: DataFrame, targets: DataFrame, size: Column | str, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20) -> DataFrame:
    """``doc_id``, ``own_source``, ``for_source``, ``copies``, ``n_tokens`` of the documents in the mix.

    ``targets`` holds ``source``, ``weight`` (shares are weights over their sum;
    null or negative: 0) and ``max_repeats`` (null or negative: 0). The mix is as
    large, in ``size``, as all documents of the sources in ``targets``. No
    document appears more than its source's ``max_repeats`` times, nor more
    often for another source than that one allows. Documents of
    other or null sources, and those of size 0, null or empty text among them,
    don't take part; an empty table gives no rows; other columns are ignored.
    Of repeated rows, each is a document. A document whose very text stands in
    several archives may stand for any of them. Sources that can't reach their
    share even so take what they can, and the rest goes to the others by weight.

    Documents are aggregated by membership pattern (own source and the sources
    with the same text, found by a 256-bit digest). The flow is solved over
    those classes, at most ``MAX_CELLS`` cells, and its amounts are met by
    documents in an order of the seed, ``doc_id`` and the digest, whatever the
    layout of the table; only rows that are equal in all three and the source
    are numbered. Tokens are summed by class and slice of that
    order, and only within a slice documents are put in line. A class's amount
    is met to within one document.
    """
    spark = documents.sparkSession
    wanted = {r.source: (float(r.weight or 0), max(0, r.max_repeats or 0)) for r in targets.select("source", "weight", "max_repeats").where("source is not null").limit(MAX_CELLS + 1).collect()}
    if len(wanted) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} sources")
    size = F.col(size) if isinstance(size, str) else size
    own = documents.join(F.broadcast(spark.createDataFrame([(s,) for s in wanted], "_own string")), F.col(source) == F.col("_own"), "left_semi")
    # Written before anything is asked of the sizes, so that they are taken once.
    rows = written(own.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("own_source"), size.cast("long").alias("n_tokens"), F.sha2(F.col(text), 256).alias("digest")))
    equal = rows.where("n_tokens > 0").groupBy("doc_id", "own_source", "n_tokens", "digest").agg(F.count(F.lit(1)).alias("n"))
    sized = written(equal.select("doc_id", "own_source", "n_tokens", "digest", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("row")))

    # Only texts that stand in more than one archive need a look-up; each archive counts once.
    shared = (
        sized.groupBy("digest").agg(F.min("own_source").alias("a"), F.max("own_source").alias("b"), F.collect_set("own_source").alias("members"))
        .where("a <> b").select("digest", F.array_sort("members").alias("members"))
    )
    several = lookup(sized, "digest", shared, "members", F.xxhash64("doc_id", "row")).withColumn("members", F.coalesce("members", F.array("own_source")))
    several = several.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "digest", "own_source", "row"))
    several = written(several)
    summed = several.groupBy("own_source", "members").agg(F.sum("n_tokens").alias("tokens"))
    found = summed.orderBy("own_source", "members").limit(MAX_CELLS + 1).collect()
    classes = [(i, r.own_source, list(r.members), int(r.tokens)) for i, r in enumerate(found)]
    flow, _ = route(classes, wanted, sum(c[3] for c in classes))

    plan, spans = [], []
    for number, own_source, members, tokens in classes:
        start = 0
        for s in sorted(wanted):
            if amount := flow.get((number, s), 0):
                spans.append((number, s, start, start + amount))
                start += amount
        plan.append((number, own_source, members, tokens, start))
    planned = F.broadcast(spark.createDataFrame(plan, "class int, own_source string, members array<string>, tokens long, amount long"))
    drawn = several.join(planned, ["own_source", "members"]).withColumn("slice", F.shiftright(F.col("place"), 52))
    slices = drawn.groupBy("class", "slice").agg(F.sum("n_tokens").alias("in_slice"))
    before = F.sum("in_slice").over(Window.partitionBy("class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select("class", "slice", F.coalesce(before, F.lit(0)).alias("before_slice"))
    within = F.sum("n_tokens").over(Window.partitionBy("class", "slice").orderBy("place", "doc_id", "digest", "own_source", "row").rowsBetween(Window.unboundedPreceding, -1))
    lined = drawn.withColumn("within", F.coalesce(within, F.lit(0))).join(slices, ["class", "slice"]).withColumn("start", F.col("before_slice") + F.col("within"))
    # The copies of a class lie end to end; a copy that begins before the amount is reached is in the mix.
    copies = F.ceil((F.col("amount") - F.col("start")) / F.col("tokens")).cast("int")
    taken = lined.where("start < amount").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).withColumn("at", F.col("start") + F.col("copy") * F.col("tokens"))
    spans_df = F.broadcast(spark.createDataFrame(spans, "class int, for_source string, span_start long, span_end long"))
    placed = taken.join(spans_df, "class").where("at >= span_start and at < span_end")
    return placed.groupBy("row", "doc_id", "digest", "own_source", "for_source", "n_tokens").agg(F.count(F.lit(1)).cast("int").alias("copies")).drop("row", "digest")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: target and actual share, tokens, documents and repeats of a mix."""
    by_source = mixed.groupBy(F.col("for_source").alias("source")).agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"),
        F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_repeats"))
    named = targets.where("source is not null").select("source", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("w"), "max_repeats")
    every = Window.partitionBy()  # over one row per source
    out = named.join(by_source, "source", "left").na.fill(0, ["tokens", "n_documents", "n_copies", "most_repeats"])
    return out.select(
        "source", (F.col("w") / F.sum("w").over(every)).alias("target_share"),
        F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(every)), F.lit(0.0)).alias("actual_share"),
        "tokens", "n_documents", "n_copies", "most_repeats", "max_repeats")
