"""The published tutorial election: per-ballot records in, printed tallies out."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from psephos.operators import tally
from psephos.sources import io

TEXT = Path(__file__).resolve().parents[1].joinpath("FIXTURES.md").read_text()
PRECINCT = {"groupA": "0045102", "groupB": "0063032"}


def table_after(heading: str) -> list[list[str]]:
    part = TEXT[TEXT.index(heading) :]
    rows = []
    for line in part.splitlines()[1:]:
        if line.startswith("| ") and not line.startswith("| ---"):
            rows.append([c.strip() for c in line.strip("|").split(" | ")])
        elif rows and not line.startswith("|"):
            break
    return [[c.strip(" |") for c in r] for r in rows[1:]]


def golden(section: str) -> dict:
    out = {}
    for contest, over, under, ballots, choices in table_after(f"**{section}**"):
        out[contest] = (int(over), int(under), int(ballots), {k: int(n) for k, n in re.findall(r"(?:^|; )(.*?)=(\d+)", choices)})
    return out


@pytest.fixture(scope="module")
def votes(spark):
    records = table_after("## F3. Golden tutorial election: per-ballot CVRs")
    assert len(records) == 87
    rows = []
    for ballot, contest, entries in records:
        status = entries if entries in ("OVERVOTED", "UNDERVOTED") else "OK"
        group = ballot.split("/")[0]
        for label in entries.split("; ") if status == "OK" else ["-"]:
            rows.append((ballot, contest, label, int(status == "OK"), status, PRECINCT[group], ballot + ".png"))
    return spark.createDataFrame(rows, "ballot_id string, cid string, label string, filled int, status string, precinct string, path string")


def result(rows, counts, key):
    out = {}
    for r in counts:
        out.setdefault(r[key] or "TOTAL", {})[r.cid] = [r.over, r.under, r.ballots, {}]
    for r in rows:
        if r.votes:
            out[r[key] or "TOTAL"][r.cid][3][r.label] = r.votes
    return {s: {c: tuple(v) for c, v in x.items()} for s, x in out.items()}


def test_precinct_tally(votes):
    sets = [[], ["precinct"]]
    one = votes.select("ballot_id", "cid", "status", "precinct").distinct()
    out = result(tally.tally(votes, ["precinct"], sets).collect(), tally.counters(one, ["precinct"], sets).collect(), "precinct")
    assert out["TOTAL"] == golden("tutorial — TOTAL")
    for p in PRECINCT.values():
        assert out[p] == golden(f"tutorial — Precinct: {p}")


def test_batch_tally_equals_precincts(votes):
    rows = tally.tally_by_batch(votes).where("votes > 0").collect()
    for batch, section in (("TOTAL", "TOTAL"), ("groupA", "Precinct: 0045102"), ("groupB", "Precinct: 0063032")):
        own = {}
        for r in rows:
            if r.batch == batch:
                own.setdefault(r.cid, {})[r.label] = r.votes
        assert own == {c: x[3] for c, x in golden(f"tutorial — {section}").items() if x[3]}


def test_winners(votes):
    w = {r.cid: r.winner for r in tally.winners(tally.tally(votes, [], [[]]), ["cid"]).collect()}
    assert w["Measure A"] == "Yes" and w["Measure B"] == "Yes" and w["US Senator"] == "Dianne Feinstein"
    assert w["Member, County Central Committee (69 Dist)"] == "Tie" and w["US Rep (48th Dist)"] == "Writein"


def test_ballot_without_attribute_is_in_the_total_only(votes):
    sets = [[], ["precinct"]]
    lost = votes.withColumn("precinct", F.when(F.col("ballot_id") != "groupA/A_02_side0", F.col("precinct")))
    one = tally.counters(lost.select("ballot_id", "cid", "status", "precinct").distinct(), ["precinct"], sets).where("cid = 'Measure A'").collect()
    assert sorted((r.level, r.ballots) for r in one) == [("TOTAL", 9), ("precinct", 3), ("precinct", 5)]


def test_texts_and_report(votes, tmp_path):
    texts = io.cvr_texts(votes.withColumn("title", F.col("cid")))
    io.write_text_tree(texts, str(tmp_path))
    lines = (tmp_path / "groupB/B_02_side0.txt").read_text().splitlines()
    assert lines[lines.index("Measure A") + 1] == "\tOVERVOTED" and lines[lines.index("Proposition 28") + 1] == "\tNo"
    t = tally.tally(votes, [], [[]]).where("votes > 0").select(F.col("level").alias("section"), F.col("cid").alias("title"), "label", "votes")
    assert "Measure A\n\t2\tNo\n\t4\tYes\n" in io.report(t)
