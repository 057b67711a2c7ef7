"""Partitions, attributes, groups, and set operations on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.operators.ranking import dense_ids, sent_if_few


def partition_by_code(codes: DataFrame) -> DataFrame:
    """Ballots whose codes, in page order, are the same are one partition (ballot_id, page, code)."""
    tag = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "code"))), lambda x: x["code"]), "_")
    tagged = codes.groupBy("ballot_id").agg(tag.alias("tag"))
    return dense_ids(tagged, ["tag"], "partition_id")


def partition_stats(parts: DataFrame) -> DataFrame:
    """Number, largest and smallest size of partitions."""
    return parts.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("partitions"), F.max("n").alias("largest"), F.min("n").alias("smallest"))


def page_deviants(parts: DataFrame) -> DataFrame:
    """Ballots with fewer images than the most in their partition get partitions of their own (partition_id, ballot_id, pages)."""
    most = F.max("pages").over(Window.partitionBy("partition_id"))
    return parts.withColumn("most", most).withColumn("key", F.when(F.col("pages") < F.col("most"), F.concat_ws(":", F.lit("own"), "ballot_id")).otherwise(F.concat_ws(":", F.lit("part"), "partition_id")))


def majority(codes: DataFrame, by: list[str], code: str = "code") -> DataFrame:
    """The most frequent code of each group, the smallest of several; with its count."""
    n = codes.groupBy(*by, code).agg(F.count(F.lit(1)).alias("n"))
    most = n.groupBy(*by).agg(F.max("n").alias("n"))
    return n.join(most, [*by, "n"]).groupBy(*by, "n").agg(F.min(code).alias(code))


def group_by_properties(attrs: DataFrame, ignore: list[str]) -> DataFrame:
    """Groups of ballots with the same properties, those of `ignore` (for tabulation only) left out (ballot_id, attr_type, attr_val)."""
    key = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attr_type", "attr_val"))), lambda x: F.concat_ws("=", x["attr_type"], x["attr_val"])), ";")
    keyed = attrs.where(~F.col("attr_type").isin(*ignore)).groupBy("ballot_id").agg(key.alias("props"))
    return dense_ids(keyed, ["props"], "group_id")


def spread(values: DataFrame, members: DataFrame, on: str) -> DataFrame:
    """What holds for a partition or group holds for each of its members, of which there may be any number."""
    return members.join(sent_if_few(values, "spread"), on)


def worst_status(events: DataFrame) -> DataFrame:
    """Of several states of a ballot, discarded beats quarantined beats ok."""
    level = F.max(F.when(F.col("status") == "discarded", 2).when(F.col("status") == "quarantined", 1).otherwise(0))
    return events.groupBy("ballot_id").agg(level.alias("level")).select("ballot_id", F.when(F.col("level") == 2, "discarded").when(F.col("level") == 1, "quarantined").otherwise("ok").alias("status"))


def union_of(*tables: DataFrame) -> DataFrame:
    """Distinct ballot_id of all tables."""
    out = tables[0].select("ballot_id")
    for t in tables[1:]:
        out = out.unionByName(t.select("ballot_id"))
    return out.distinct()


def without(df: DataFrame, gone: DataFrame, on: str = "ballot_id") -> DataFrame:
    return df.join(gone.select(on).distinct(), on, "left_anti")


def counter(df: DataFrame, key: str) -> DataFrame:
    """A multiset: key, n."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def counter_op(a: DataFrame, b: DataFrame, key: str, op: str) -> DataFrame:
    """Multiset sum, difference, union (greater count) or intersection (lesser count); only positive counts stay."""
    x, y = F.coalesce("a.n", F.lit(0)), F.coalesce("b.n", F.lit(0))
    n = {"+": x + y, "-": x - y, "|": F.greatest(x, y), "&": F.least(x, y)}[op]
    return a.alias("a").join(b.alias("b"), key, "full").select(key, n.alias("n")).where("n > 0")


def most_common(counts: DataFrame, key: str, n: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), key).limit(n)


def value_domain(domain: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Every combination of the domain, with its number of members, 0 where there is none."""
    return domain.join(groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def joined_digits(digits: DataFrame, by: list[str], position: str = "pos", digit: str = "digit") -> DataFrame:
    """Digits of each group as one string in the order of their positions; contiguous: these are 0, 1, 2, ..."""
    ordered = F.array_sort(F.collect_list(F.struct(position, digit)))
    out = digits.groupBy(*by).agg(ordered.alias("_d"), F.min(position).alias("_lo"), F.max(position).alias("_hi"), F.count_distinct(position).alias("_n"))
    return out.select(*by, F.array_join(F.transform("_d", lambda x: x[digit].cast("string")), "").alias("digits"), ((F.col("_lo") == 0) & (F.col("_hi") == F.col("_n") - 1)).alias("contiguous"))


def upper_median_gap(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The upper median of the differences of neighbouring values; their least where there are two at most."""
    gap = F.lead(value).over(Window.partitionBy(*by).orderBy(value)) - F.col(value)
    gaps = values.select(*by, gap.alias("gap")).where("gap is not null")
    ordered = F.array_sort(F.collect_list("gap"))
    return gaps.groupBy(*by).agg(ordered.alias("g")).select(*by, F.when(F.size("g") <= 2, F.element_at("g", 1)).otherwise(F.get("g", F.floor(F.size("g") / 2).cast("int"))).alias("median_gap"))


def rank_votes(lists: DataFrame, by: list[str]) -> DataFrame:
    """Members of a group each rank labels; a label's weight is the sum of 2 to the power of minus its rank (by..., labels)."""
    one = lists.select(*by, F.posexplode("labels").alias("pos", "label"))
    weights = one.groupBy(*by, "label").agg(F.sum(F.pow(F.lit(0.5), "pos")).alias("weight"))
    return weights.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "label")))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements in which two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1).cast("int")


def split_ranked(members: DataFrame, group: str, key: str, labels: str = "labels") -> DataFrame:
    """Groups split by their members' ranked labels: group, key, part.

    part is the label after the labels that all members of the group share, at least the second one.  Where all lists are the group's first one, or no second part comes out, the group is
    halved in order of key, the first half the larger (parts 'first' and 'second'); a group with a list of one label, or none, stays (part null).
    """
    w = Window.partitionBy(group)
    first = F.first(labels).over(w.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = members.withColumn("_first", first).withColumn("_shared", F.min(common_prefix(F.col(labels), F.col("_first"))).over(w)).withColumn("_shortest", F.min(F.size(labels)).over(w))
    seen = seen.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_place", F.row_number().over(w.orderBy(key))).withColumn("_part", F.get(labels, F.greatest(F.lit(1), F.col("_shared"))))
    kinds = seen.withColumn("_kinds", F.size(F.collect_set("_part").over(w)) + F.max(F.col("_part").isNull().cast("int")).over(w))
    half = F.when(F.col("_place") <= F.floor((F.col("_n") + 1) / 2), "first").otherwise("second")
    naive = F.col("_shared") == F.size("_first")
    part = F.when(naive, half).when(F.col("_shortest") <= 1, F.lit(None)).when(F.col("_kinds") == 1, half).otherwise(F.col("_part"))
    return kinds.select(group, key, part.alias("part"))


def current_label(labels: Column, index: Column) -> Column:
    """The label that a reviewer is at: the ranked labels in a circle."""
    return F.when(F.size(labels) > 0, F.get(labels, F.pmod(index, F.size(labels)).cast("int")))


def combined_lists(parts: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """What parallel tasks found, put together: the lists of each key on end, in order of the tasks.  (A table of rows needs only a union; results that nobody asks for are not collected.)"""
    own = F.array_sort(F.collect_list(F.struct(*order, value)))
    return parts.groupBy(key).agg(F.flatten(F.transform(own, lambda x: x[value])).alias(value))


def merged(first: DataFrame, later: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two tables of values by key; where both have a key, the later value stands."""
    both = first.select(*keys, F.lit(0).alias("_turn"), value).unionByName(later.select(*keys, F.lit(1).alias("_turn"), value))
    return both.groupBy(*keys).agg(F.max_by(value, F.struct("_turn", value)).alias(value))


def audited(everybody: DataFrame, known: DataFrame, value: str, excused: Column, on: str = "ballot_id") -> DataFrame:
    """on, value, error: a missing value is an error unless it is excused."""
    return everybody.join(known.select(on, value), on, "left").select(on, value, (F.col(value).isNull() & ~excused).alias("error"))


def five_colours(near: dict, colours: int = 5) -> dict | None:
    """A colour for each node of a graph (node: neighbours), neighbours unlike: for planar graphs five always do.  None if a node finds none.

    Nodes are taken off, one with the fewest neighbours left at a time, and coloured in the opposite order.  Where all colours stand around a node, two of them are exchanged along the chain of
    nodes of these two colours from a neighbour, if that chain does not come back to the node.
    """
    left, order = {i: set(own) for i, own in near.items()}, []
    while left:
        i = min(left, key=lambda x: (len(left[x]), x))
        for j in left.pop(i):
            left[j].discard(i)
        order.append(i)
    found: dict = {}

    def chain(start, one, other):
        seen, todo = {start}, [start]
        while todo:
            todo += (more := {j for j in near[todo.pop()] if found.get(j) in (one, other)} - seen)
            seen |= more
        return seen

    for i in reversed(order):
        by = {}
        for j in near[i]:
            if j in found:
                by.setdefault(found[j], []).append(j)
        free = next((c for c in range(colours) if c not in by), None)
        for one in sorted(by) if free is None else ():
            for other in sorted(by):
                moved = set().union(*(chain(j, one, other) for j in by[one])) if one != other else None
                if moved is not None and not moved & set(by[other]):
                    for j in moved:
                        found[j] = other if found[j] == one else one
                    free = one
                    break
            if free is not None:
                break
        if free is None:
            return None
        found[i] = free
    return found


def coloured(nodes: DataFrame, edges: DataFrame, on: str, colours: int = 5, steps: int = 100_000) -> DataFrame:
    """A colour from 0 for each node (on, id), so that the ends of an edge (on, a_id, b_id) differ, style by style.

    five_colours first, which does for planar graphs with five colours and takes polynomial time; where it finds none, a search of at most `steps` steps.  Null for a style without a result.
    """
    import pandas as pd

    def search(own, links):
        near = {i: set() for i in own}
        for x in links if links is not None else ():
            near[x["a_id"]].add(x["b_id"])
            near[x["b_id"]].add(x["a_id"])
        quick = five_colours(near, colours)
        if quick is not None:
            return sorted(quick.items())
        ids, found, at, tried, left = sorted(near, key=lambda i: (-len(near[i]), i)), {}, 0, [-1] * (len(near) + 1), steps
        while 0 <= at < len(ids) and left:
            left -= 1
            taken = {found[j] for j in near[ids[at]] if j in found}
            free = next((c for c in range(tried[at] + 1, colours) if c not in taken), None)
            if free is None:
                tried[at], at = -1, at - 1
                if at >= 0:
                    del found[ids[at]]
            else:
                found[ids[at]] = tried[at] = free
                at += 1
        return [(i, found.get(i) if at == len(ids) else None) for i in ids]

    def run(it):
        for pdf in it:
            rows = [(k, *x) for k, own, links in zip(pdf[on], pdf["_ids"], pdf["_links"]) for x in search(own, links)]
            yield pd.DataFrame(rows, columns=[on, "id", "colour"]).astype({"colour": "Int64"})

    styles = nodes.groupBy(on).agg(F.collect_list("id").alias("_ids")).join(edges.groupBy(on).agg(F.collect_list(F.struct("a_id", "b_id")).alias("_links")), on, "left")
    kinds = dict(nodes.dtypes)
    return styles.mapInPandas(run, f"{on} {kinds[on]}, id {kinds['id']}, colour long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of an edge (a, b) can reach.  Labels go to neighbours and are then looked up in themselves, so paths halve each round; every round is a written table."""
    from psephos.sources.io import written

    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("r"))
        step = labels.join(near, F.col("node") == F.col("n")).select("node", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        of = labels.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        new = written(step.join(of, F.col("root") == F.col("_node")).select("node", F.least("root", "_root").alias("root"), "was"), "labels")
        if new.where("root <> was").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
