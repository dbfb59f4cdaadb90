"""All contract cases in one scoring job."""

import pytest

import contract_cases as cc
from doorlens.scoring.engine import score


@pytest.fixture(scope="module")
def result(spark):
    return {name: df.collect() for name, df in score(**cc.frames(spark)).items() if name != "wide"}


@pytest.fixture(scope="module")
def evidence(result):
    rows = {}
    for e in result["evidence"]:
        rows.setdefault(e.pams_pin, []).append(e)
    return rows


@pytest.mark.parametrize("name", list(cc.CASES))
def test_case(result, evidence, name):
    want = cc.CASES[name][1]
    door = next(r for r in result["doors"] if r.pams_pin == name)
    got = {
        "project": door.project, "capacity": door.capacity, "fit": door.fit, "base": door.base,
        "days": door.days_since_move, "strength": round(door.mover_strength, 3), "lift": round(door.mover_lift, 3),
        "rental": door.rental_modifier, "pre": round(door.pre_rounding, 3), "adj": round(door.adjustment, 3),
        "score": door.score, "confidence": door.confidence, "gaps": sorted(door.data_gaps),
        "evidence": sorted((e.type, round(e.points, 3)) for e in evidence.get(name, [])),
    }
    assert got == want


def test_evidence_adds_up_and_is_numbered(result, evidence):
    for door in result["doors"]:
        rows = evidence.get(door.pams_pin, [])
        assert sum(e.points for e in rows) == pytest.approx(door.pre_rounding, abs=1e-9)
        assert door.pre_rounding + door.adjustment == pytest.approx(door.score, abs=1e-9)
        assert sorted(e.seq for e in rows) == list(range(len(rows)))


def test_no_identity_text_reaches_the_output(result):
    assert "JANE" not in str(result) and "PO BOX" not in str(result)


def test_reasons(evidence):
    def reason(name, kind):
        return next(e.reason for e in evidence[name] if e.type == kind)

    assert reason("G-002", "fit_roof_age") == (
        "latest completed roof installation was 2006-06-20 — 20 years old, old enough to need service")
    assert reason("G-002", "capacity_local_relative_value") == (
        "assessed at $650,000, 1.30× the $500,000 median of the nearest 20 single-family comparables")
    assert reason("G-028", "fit_roof_age") == (
        "1 roof-related permit record on file (ROOF, issued 2006-05-01), but none establish a completed installation age")
    assert reason("G-032", "fit_pool") == (
        "pool established by a completed permit (in-ground pool installation, issued 2015-05-01) and confirmed in "
        "aerial imagery — a standing maintenance commitment")
    assert reason("G-024", "capacity_territory_percentile") == (
        "assessed value sits at the 90th percentile of the 20 territory single-family properties")
    order = [e.type for e in sorted(evidence["G-018"], key=lambda e: e.seq)]
    assert order == ["project_active", "project_completed", "project_active", "project_active",
                     "project_cap_adjustment"]
