"""Incremental runs equal full rebuilds, and detect again only what changed."""

import random
from datetime import datetime

import pytest
from frames import billing, line, meta, terms, tuples
from pyspark.sql import functions as F

from duecheck.operators import changes
from duecheck.operators import findings as f
from duecheck.plans import run
from duecheck.sources import snapshots

RUN_AT = datetime(2026, 3, 1)
SHOWN = ["finding_id", "customer_id", "month", "product", "leak_type", "estimated_recovery", "evidence", "draft_memo", "detected_by"]


class Corpus:
    """Rows per account that a test changes at random."""

    def __init__(self, seed):
        self.draw = random.Random(seed)
        self.lines = [self.line(c, m) for c in range(1, 13) for m in range(1, 5) for _ in range(self.draw.randint(0, 2))]
        self.terms = [(c, p, "5", arm) for c in range(1, 13) for p in "AB" for arm in ("regex_baseline", "json_terms")]
        self.meta = [(c, "10", "2026-02-28", "40", "regex_baseline") for c in range(1, 13)]

    def line(self, c, m):
        rate = self.draw.choice(["4", "5"])
        return line(c, f"2026-{m:02d}", self.draw.choice("AB"), self.draw.randint(1, 9), rate, self.draw.choice(["0", "10"]), "12")

    def change(self):
        kind = self.draw.randrange(5)
        if kind == 0:
            self.lines.append(self.line(self.draw.randint(1, 14), self.draw.randint(1, 4)))
        elif kind == 1:
            self.lines.pop(self.draw.randrange(len(self.lines)))
        elif kind == 2:
            self.lines.append(self.draw.choice(self.lines))  # a repeated line
        elif kind == 3:
            i = self.draw.randrange(len(self.terms))
            self.terms[i] = (*self.terms[i][:2], self.draw.choice(["4", "6"]), self.terms[i][3])
        else:
            self.meta.pop(self.draw.randrange(len(self.meta)))

    def tables(self, spark):
        return billing(spark, *self.lines), terms(spark, *self.terms), meta(spark, *self.meta)


def shown(spark, path):
    return sorted(map(str, f.read_findings(spark, path).select(*SHOWN).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_full_rebuild_after_random_changes(spark, tmp_path, seed):
    corpus, part, whole = Corpus(seed), str(tmp_path / "part"), str(tmp_path / "whole")
    for _ in range(3):
        report = run.reconcile_changes(*corpus.tables(spark), part, run_at=RUN_AT).first()["report"]
        assert report == run.reconcile(*corpus.tables(spark), whole, run_at=RUN_AT).first()["report"]
        assert shown(spark, part) == shown(spark, whole)
        for path in (part, whole):
            run.draft(spark, path, "sql_baseline").collect()
        for _ in range(corpus.draw.randint(1, 3)):
            corpus.change()


def test_only_changed_accounts_are_detected_again(spark, tmp_path, monkeypatch):
    corpus, path, asked = Corpus(5), str(tmp_path / "f"), []
    detect = run.detect_leaks
    monkeypatch.setattr(run, "detect_leaks", lambda b, t, m: asked.append({r[0] for d in (b, t, m) for r in d.select("customer_id").collect()}) or detect(b, t, m))
    run.reconcile_changes(*corpus.tables(spark), path)
    corpus.lines.append(corpus.line(3, 2))
    corpus.terms = [t for t in corpus.terms if t[0] != 7]
    corpus.lines = [x for x in corpus.lines if x[1] != 9]
    run.reconcile_changes(*corpus.tables(spark), path)
    run.reconcile_changes(*corpus.tables(spark), path)
    run.reconcile_changes(*corpus.tables(spark), path, arms=["sql_baseline"])  # other rules: all again
    everyone = set(range(1, 13))
    assert asked == [everyone, {3, 7, 9}, set(), everyone]


def test_a_run_that_was_overtaken_starts_again(spark, tmp_path, monkeypatch):
    """Between reading the fingerprints and storing them, another run with other billing is first."""
    corpus, path = Corpus(6), str(tmp_path / "f")
    run.reconcile_changes(*corpus.tables(spark), path)
    old = corpus.tables(spark)
    corpus.lines = [x for x in corpus.lines if x[1] != 4]
    detect, once = run.detect_leaks, iter([True])

    def overtaken(*tables):
        if next(once, False):
            run.reconcile_changes(*old, path)
        return detect(*tables)

    monkeypatch.setattr(run, "detect_leaks", overtaken)
    run.reconcile_changes(*corpus.tables(spark), path, run_at=RUN_AT)
    monkeypatch.undo()
    whole = str(tmp_path / "whole")
    run.reconcile(*corpus.tables(spark), whole, run_at=RUN_AT)
    assert shown(spark, path) == shown(spark, whole)


def test_a_failure_before_the_fingerprints_is_made_good(spark, tmp_path, monkeypatch):
    corpus, path = Corpus(7), str(tmp_path / "f")
    run.reconcile_changes(*corpus.tables(spark), path)
    corpus.change()
    with monkeypatch.context() as m:
        m.setattr(run, "replace_table", lambda *a: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            run.reconcile_changes(*corpus.tables(spark), path)
    run.reconcile_changes(*corpus.tables(spark), path, run_at=RUN_AT)
    whole = str(tmp_path / "whole")
    run.reconcile(*corpus.tables(spark), whole, run_at=RUN_AT)
    assert shown(spark, path) == shown(spark, whole)
    assert snapshots.versions(spark, f"{path}_accounts") == [1, 2]


def test_fingerprints_see_every_row_and_no_order(spark):
    rows = billing(spark, *[line(1, "2026-01", "A", i, "5") for i in range(20)], line(None, "2026-01", "A", 1, "5"))
    base = changes.account_fingerprints({"billing": rows}, "r")
    assert base.count() == 1
    same = changes.account_fingerprints({"billing": rows.repartition(7).orderBy(F.rand(3))}, "r")
    assert changes.changed_accounts(base, same).isEmpty()
    for other in (rows.unionByName(rows.limit(1)), rows.where("units <> 3"), rows.withColumn("units", F.when(F.col("units") == 3, 4).otherwise(F.col("units")))):
        now = changes.account_fingerprints({"billing": other}, "r")
        assert tuples(changes.changed_accounts(base, now), "customer_id") == [(1,)]
    swapped = changes.account_fingerprints({"terms": rows}, "r")
    assert changes.changed_accounts(base, swapped).count() == 1
