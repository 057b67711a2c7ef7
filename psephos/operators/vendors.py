"""Ballot vendors as plug-ins: each turns decoded codes into tags that make partitions."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.functions import codes, paths
from psephos.operators.grouping import partition_by_code


class Vendor(Protocol):
    def decode(self, images: DataFrame) -> DataFrame:
        """image_path, ballot_id, page, raw -> the same with code (null if the raw string is not valid) and status."""

    def tag(self, code: Column) -> Column:
        """The part of a code by which ballots are of one style."""

    #: Columns that decode adds beside the code, by which ballots may be grouped as well; a vendor may leave this out.
    properties: tuple[str, ...]


def _status(df: DataFrame, ok: Column, code: Column) -> DataFrame:
    return df.withColumn("code", F.when(ok, code)).withColumn("status", F.when(F.col("raw").isNull(), "ioerr").when(F.col("code").isNull(), "err").otherwise("ok"))


class Hart:
    """14 digits with a checksum; precinct, language and party are those of the ballot's first image."""

    properties = ("precinct",)

    def decode(self, images: DataFrame) -> DataFrame:
        own = _status(images, codes.hart_valid(F.col("raw")), F.col("raw"))
        first = F.first(F.substring("code", 2, 6), ignorenulls=True).over(Window.partitionBy("ballot_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return own.withColumn("precinct", first)

    def tag(self, code: Column) -> Column:
        return F.concat(F.substring(code, 1, 7), F.substring(code, 10, 3))


class Diebold:
    """34 raw bits with guards; a checksum over the 32 between."""

    def decode(self, images: DataFrame) -> DataFrame:
        bits = codes.strip_guards(F.col("raw"))
        return _status(images, codes.diebold_sane(F.col("raw")) & codes.diebold_valid(bits), bits)

    def tag(self, code: Column) -> Column:
        return F.substring(code, 18, 13)


class EsS:
    """A bit string by position; pages of a ballot are tagged together."""

    def decode(self, images: DataFrame) -> DataFrame:
        return _status(images, F.coalesce(F.col("raw").rlike("^[01]+$"), F.lit(False)), F.col("raw"))

    def tag(self, code: Column) -> Column:
        return code


class Sequoia:
    """Left and right strings of eight bits, `left,right`; images come in twos, the second being a back without a code."""

    def decode(self, images: DataFrame) -> DataFrame:
        sides = F.split("raw", ",")
        front = images.withColumn("raw", F.when(F.col("page") % 2 == 1, F.lit("BACK")).otherwise(F.col("raw")))
        ok = (F.col("raw") == "BACK") | codes.sequoia_sane(sides[0], F.get(sides, F.lit(1)))
        return _status(front, F.coalesce(ok, F.lit(False)), F.col("raw"))

    def tag(self, code: Column) -> Column:
        return F.when(code != "BACK", code).otherwise("")


class DirectoryName:
    """The style is the name of the directory of the ballot's first image."""

    first_only = True

    def decode(self, images: DataFrame) -> DataFrame:
        return _status(images.withColumn("raw", paths.parent_name(F.col("image_path"))), F.lit(True), F.col("raw"))

    def tag(self, code: Column) -> Column:
        return code


class SingleTemplate:
    """All ballots are of one style."""

    first_only = True

    def decode(self, images: DataFrame) -> DataFrame:
        return _status(images.withColumn("raw", F.lit("0")), F.lit(True), F.col("raw"))

    def tag(self, code: Column) -> Column:
        return F.lit("0")


VENDORS: dict[str, type] = {"hart": Hart, "diebold": Diebold, "ess": EsS, "sequoia": Sequoia, "dirname": DirectoryName, "single": SingleTemplate}


def grouping_properties(vendor: str) -> tuple[str, ...]:
    """What a vendor's decode says of a ballot beside its code."""
    return tuple(getattr(VENDORS[vendor], "properties", ()))


def contest_stripes(contests: DataFrame, targets: DataFrame, on: list[str], above: int = 10) -> DataFrame:
    """on, stripe, upper, lower: where to cut a contest (on, y1, y2) into its title and a stripe for each target (on, x1, y1), in the contest's own rows.

    Where targets spread more down than across, a stripe begins `above` pixels over its target; otherwise one stripe below the title holds all targets.  A first target at the very top leaves
    an empty title.
    """
    spread = targets.groupBy(*on).agg((F.max("y1") - F.min("y1") > F.max("x1") - F.min("x1")).alias("_down"), F.array_sort(F.collect_list("y1")).alias("_tops"))  # a contest's targets are few
    own = contests.join(spread, on)
    height = F.col("y2") - F.col("y1")
    starts = F.transform("_tops", lambda y: y - F.col("y1") - above)
    first = F.get(starts, F.lit(0))
    cuts = F.concat(F.array(F.lit(0).cast("long"), F.greatest(first, F.lit(0)).cast("long")), F.transform(F.slice(starts, 2, F.size(starts)), lambda y: y.cast("long")), F.array(F.col("y2").cast("long")))
    cuts = F.when(F.col("_down"), cuts).otherwise(F.slice(cuts, 1, 2))
    pairs = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_cuts") - 1), lambda i: F.struct(F.get("_cuts", i - 1).alias("upper"), F.get("_cuts", i).alias("lower")))).alias("stripe", "s")
    last = F.when(F.col("_down"), F.array().cast("array<bigint>")).otherwise(F.array(F.col("y2").cast("long"), F.col("y2").cast("long")))
    return own.withColumn("_cuts", F.concat(cuts, last)).where(height >= 0).select(*on, pairs).select(*on, "stripe", "s.upper", "s.lower")


def partition(images: DataFrame, vendor: str, manual: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(partitions of the ballots that decode, images that do not).  manual: image_path, code given by people, put in whole.

    Ballots with an image that does not decode are left out, as their pages would be partial.
    """
    v = VENDORS[vendor]()
    decoded = v.decode(images)
    if manual is not None:
        given = manual.select("image_path", F.col("code").alias("_given"))
        decoded = decoded.join(given, "image_path", "left").withColumn("code", F.coalesce("_given", "code")).withColumn("status", F.when(F.col("_given").isNotNull(), "ok").otherwise(F.col("status"))).drop("_given")
    bad = decoded.where("status <> 'ok'")
    good = decoded.join(bad.select("ballot_id").distinct(), "ballot_id", "left_anti")
    tags = good.select("ballot_id", "page", v.tag(F.col("code")).alias("code"))
    if getattr(v, "first_only", False):
        tags = tags.groupBy("ballot_id").agg(F.min("page").alias("page"), F.min_by("code", "page").alias("code"))
    return partition_by_code(tags), bad
