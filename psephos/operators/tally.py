"""Contest status, cast-vote records, tallies and winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.operators.ranking import global_rank


_PLACE = ("intensity", "ballot_id", "page", "target_id")


def ranked(marks: DataFrame) -> DataFrame:
    """Every mark's rank by intensity, then ballot, page and target."""
    return global_rank(marks, [F.col("intensity"), F.shiftright("ballot_id", 12)], ["ballot_id", "page", "target_id"])


def cut(marks: DataFrame, threshold: int) -> DataFrame:
    """One row: the mark of rank `threshold` as a struct; null if there are fewer marks.

    Counts by intensity, and within the intensity that holds it by runs of 4096 ballots, say in which run it lies; only that run's marks are ranked, so no other mark is moved.
    """
    bins = marks.groupBy("intensity", F.shiftright("ballot_id", 12).alias("_run")).agg(F.count(F.lit(1)).alias("_n"))
    first = _holding(bins.groupBy("intensity").agg(F.sum("_n").alias("_n")), "intensity", F.lit(threshold))  # as many rows as there are intensities
    runs = bins.join(F.broadcast(first.select("intensity", "_rank")), "intensity")  # one row
    run = _holding(runs, "_run", F.col("_rank")).select(F.col("intensity").alias("_i"), F.col("_run").alias("_r"), "_rank")
    own = marks.select(*_PLACE).join(F.broadcast(run), (F.col("intensity") == F.col("_i")) & (F.shiftright("ballot_id", 12) == F.col("_r")))  # one row
    placed = own.withColumn("_k", F.row_number().over(Window.orderBy(*_PLACE)) - 1)  # one intensity's marks on 4096 ballots
    return placed.where("_k = _rank").agg(F.first(F.struct(*_PLACE)).alias("_cut"))


def _holding(counts: DataFrame, by: str, rank: Column) -> DataFrame:
    """The row that holds the rank-th of all that are counted (_n) in the order of `by`, with the rank within it as _rank."""
    up_to = counts.withColumn("_to", F.sum("_n").over(Window.orderBy(by))).withColumn("_rank", rank - F.col("_to") + F.col("_n"))
    return up_to.where("_rank >= 0 and _rank < _n").drop("_to")


def classify(marks: DataFrame, threshold: int, wrong: DataFrame | None = None) -> DataFrame:
    """is_filled: the mark's rank by intensity is under the threshold, exclusive-or a human override (ballot_id, page, target_id).

    A mark is under it if it sorts before the mark of that rank, so marks are not moved.
    """
    under = F.coalesce(F.struct(*_PLACE) < F.col("_cut"), F.lit(True))
    out = marks.join(F.broadcast(cut(marks, threshold))).withColumn("is_filled", under).drop("_cut")  # one row
    if wrong is None:
        return out
    flagged = wrong.select("ballot_id", "page", "target_id").distinct().withColumn("_wrong", F.lit(True))
    return out.join(flagged, ["ballot_id", "page", "target_id"], "left").withColumn("is_filled", F.col("is_filled") != F.coalesce("_wrong", F.lit(False))).drop("_wrong")


def contest_status(results: DataFrame, contests: DataFrame) -> DataFrame:
    """Per ballot and contest: votes and status.  More votes than allowed is OVERVOTED, none UNDERVOTED; fewer than allowed is OK.

    Several marks on one choice are one vote.  Returns ballot_id, cid, upto, choice, filled, votes, status, first; filled is 0 unless OK, and first is true for one choice of each ballot and
    contest.  One aggregation: marks that are dealt out by ballot already are not moved, others once.  The contests, one row each, go to all tasks: joined by a shuffle, each contest's ballots
    would be one task's.
    """
    own = results.groupBy("ballot_id", "cid").agg(F.collect_set("choice").alias("choices"), F.collect_set(F.when(F.col("is_filled"), F.col("choice"))).alias("marked"))
    known = own.join(F.broadcast(contests.select("cid", "upto")), "cid").withColumn("votes", F.size("marked").cast("long"))
    status = F.when(F.col("votes") > F.col("upto"), "OVERVOTED").when(F.col("votes") == 0, "UNDERVOTED").otherwise("OK")
    out = known.withColumn("status", status).withColumn("least", F.array_min("choices")).select("*", F.explode("choices").alias("choice"))
    filled = F.when(F.col("status") == "OK", F.array_contains("marked", F.col("choice")).cast("int")).otherwise(0)
    return out.select("ballot_id", "cid", "upto", "choice", filled.alias("filled"), "votes", "status", (F.col("choice") == F.col("least")).alias("first"))


def by_contest(status: DataFrame) -> DataFrame:
    """One row per ballot and contest: ballot_id, cid, votes, status."""
    return status.where("first").select("ballot_id", "cid", "votes", "status")


def tally(votes: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """Votes by choice for each grouping set.

    votes: cid, label, filled and the keys.  Choices with one label are one.  Nulls of a set that leaves a key out are told
    from null keys by level.  One shuffle: the sets expand rows before a partial aggregation.
    """
    return _expand(votes.select("cid", "label", "filled", *keys), keys, sets).groupBy("level", *keys, "cid", "label").agg(F.sum("filled").cast("long").alias("votes"))


def tally_with_counters(votes: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """tally with the contest's overvoted, undervoted and all ballots beside each label, in one pass (votes also has first): level, keys, cid, label, votes, over, under, ballots."""
    n = lambda cond: F.sum((F.col("first") & cond).cast("long"))
    per = _expand(votes, keys, sets).groupBy("level", *keys, "cid", "label").agg(
        F.sum("filled").cast("long").alias("votes"), n(F.col("status") == "OVERVOTED").alias("over"), n(F.col("status") == "UNDERVOTED").alias("under"), n(F.lit(True)).alias("ballots")
    )
    whole = Window.partitionBy("level", *keys, "cid")  # as many rows as there are labels
    return per.withColumns({c: F.sum(c).over(whole) for c in ("over", "under", "ballots")})


def counters(status: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """Overvoted, undervoted and all ballots of each contest, for each grouping set.  status: a row per ballot and contest, with the keys."""
    return _expand(status, keys, sets).groupBy("level", *keys, "cid").agg(
        F.count(F.when(F.col("status") == "OVERVOTED", 1)).alias("over"), F.count(F.when(F.col("status") == "UNDERVOTED", 1)).alias("under"), F.count(F.lit(1)).alias("ballots")
    )


def _expand(df: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    kinds = dict(df.dtypes)
    rows = [F.struct(F.lit("/".join(s) or "TOTAL").alias("level"), *[(F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys]) for s in sets]
    # a set applies to a ballot that has all its attributes; one without is in the total only
    fits = [F.lit(True) if not s else _all_known(s) for s in sets]
    sets_of_row = F.filter(F.array(*[F.when(ok, r) for ok, r in zip(fits, rows)]), lambda x: x.isNotNull())
    rest = [c for c in df.columns if c not in keys]
    return df.select(*rest, F.explode(sets_of_row).alias("_set")).select("_set.*", *rest)


def _all_known(columns: list[str]) -> Column:
    ok = F.col(columns[0]).isNotNull()
    for c in columns[1:]:
        ok = ok & F.col(c).isNotNull()
    return ok


def with_winner(tallied: DataFrame, keys: list[str], none: str = "N/A", tie: str = "Tie") -> DataFrame:
    """Adds the plurality winner of each group: the label with most votes; tie if several have them; none if nobody has a vote."""
    w = Window.partitionBy(*keys)
    top = F.when(F.col("votes") == F.max("votes").over(w), F.col("label"))
    out = tallied.withColumns({"_most": F.max("votes").over(w), "_top": top})
    name = F.when(F.col("_most") == 0, none).when(F.count("_top").over(w) > 1, tie).otherwise(F.min("_top").over(w))
    return out.withColumn("winner", name).drop("_most", "_top")


def winners(tallied: DataFrame, keys: list[str], none: str = "N/A", tie: str = "Tie") -> DataFrame:
    """One row per group: its most votes and its winner."""
    return with_winner(tallied, keys, none, tie).groupBy(*keys).agg(F.max("votes").alias("votes"), F.first("winner").alias("winner"))


def ancestors(path: Column) -> Column:
    """Every directory above a path, from the top: a/b/c.png -> [a, a/b]."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def tally_by_batch(votes: DataFrame, path: str = "path") -> DataFrame:
    """Votes by choice in total and under every directory: votes are added up by directory first, whose prefixes are then exploded, so containment is an equi-group."""
    folder = F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1))
    per = votes.groupBy(folder.alias("_folder"), "cid", "label").agg(F.sum("filled").cast("long").alias("filled"))
    above = F.when(F.col("_folder").isNotNull(), ancestors(F.concat("_folder", F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return per.select(F.explode(F.concat(F.array(F.lit("TOTAL")), above)).alias("batch"), "cid", "label", "filled").groupBy("batch", "cid", "label").agg(F.sum("filled").cast("long").alias("votes"))


def contest_key(title: Column, upto: Column, choices: Column) -> Column:
    """Contests are one if title, vote-up-to and the sorted choices agree."""
    return F.concat_ws("|", title, upto.cast("string"), F.array_join(F.array_sort(choices), ";"))


def cvr(status: DataFrame) -> DataFrame:
    """Cast-vote record, one row per ballot and contest: marks in choice order as text, and status."""
    bits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("choice", "filled"))), lambda x: x["filled"].cast("string")), ",")
    return status.groupBy("ballot_id", "cid").agg(bits.alias("marks"), F.first("status").alias("status"))


def last_image_wins(image_cvr: DataFrame) -> DataFrame:
    """A contest found on several images of a ballot: the last image's record stands (ballot_id, cid, img_ord, marks)."""
    return image_cvr.groupBy("ballot_id", "cid").agg(F.max_by("marks", "img_ord").alias("marks"), F.max("img_ord").alias("img_ord"), F.count(F.lit(1)).alias("n_images"))


def manual_status(manual: DataFrame) -> DataFrame:
    """Status of manual entries (votes: array of booleans, upto)."""
    n = F.aggregate("votes", F.lit(0), lambda a, x: a + F.when(x, 1).otherwise(0))
    return manual.withColumn("n", n).withColumn("status", F.when(F.col("n") > F.col("upto"), "OVERVOTED").when(F.col("n") == 0, "UNDERVOTED").otherwise("OK"))
