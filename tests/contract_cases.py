"""The 42 cases of the score contract as data: a plain door plus what each case changes.

Expected values are those the contract fixes: the score line, the evidence as (type, points)
and the gaps. Floats to three places.
"""

from __future__ import annotations

import datetime as dt

AS_OF = "2026-08-18"

# A quiet door: mid value, new house, small lot, all sources present, nothing to score.
QUIET = {
    "assessed": 400000.0, "portal_assessed": None, "year": 2020, "acres": 0.2, "portal": True, "acs": 0.30,
    "rental": True, "registrations": [], "imagery": True, "seen": {}, "sales": [], "permits": [], "comps": (20, 500000.0),
    "values": [400000.0, *[700000.0 + 10000 * i for i in range(10)]], "as_of": AS_OF,
}


def permit(number, text, issue, state=None, done=None, active=None, source="SDL"):
    return {"municipal_id": number, "description": text, "issue": issue, "state": state, "done": done,
            "active": active, "source": source}


ROOF_2006 = permit("SDL-2006-014", "roof replacement - remove and reshingle", "2006-05-01", "completed", "2006-06-20")
HEATER = permit("SDL-2025-201", "water heater replacement", "2025-07-10", "completed", "2025-08-15")
# A door with a base of 49.
STRONG = {
    **QUIET, "assessed": 650000.0, "year": 1946, "acres": 0.55, "permits": [ROOF_2006, HEATER],
    "values": [600000.0, 610000.0, 620000.0, 630000.0, 650000.0, *[700000.0 + 10000 * i for i in range(6)]],
}
STRONG_EVIDENCE = [
    ("capacity_local_relative_value", 7), ("fit_home_age", 10), ("fit_lot", 5), ("fit_roof_age", 12),
    ("project_completed", 15),
]


def sale(day, price=850000.0, code="", source="SR1A"):
    return {"day": day, "price": price, "code": code, "source": source}


def line(project=0, capacity=0, fit=0, days=None, strength=0.0, lift=0.0, rental=0, pre=None, adj=0.0, score=0,
         evidence=(), gaps=(), confidence="normal"):
    base = project + capacity + fit
    return {
        "project": project, "capacity": capacity, "fit": fit, "base": base, "days": days, "strength": strength,
        "lift": lift, "rental": rental, "pre": float(base) if pre is None else pre, "adj": adj, "score": score,
        "evidence": sorted((t, float(p)) for t, p in evidence), "gaps": sorted(gaps), "confidence": confidence,
    }


def strong(days=None, strength=0.0, lift=0.0, score=49, pre=49.0, adj=0.0, rental=0, more=(), gaps=()):
    evidence = [*STRONG_EVIDENCE, *more, *([("mover_recency", lift)] if lift else [])]
    return line(15, 7, 27, days, strength, lift, rental, pre, adj, score, evidence, gaps)


def quiet(score, evidence, project=0, capacity=0, fit=0, gaps=(), **rest):
    return line(project, capacity, fit, score=score, evidence=evidence, gaps=gaps, **rest)


PEAK = {"days": 47, "strength": 90.0, "lift": 47.125, "score": 96, "pre": 96.125, "adj": -0.125}
NO_MOVE = ("mover_invalid_sale", 0)
NEUTRAL = ("project_neutralized", 0)

CASES = {
    "G-001": ({**QUIET, "sales": [sale("2026-07-02")]},
              line(days=47, strength=90.0, lift=90.0, pre=90.0, score=90, evidence=[("mover_recency", 90.0)])),
    "G-002": ({**STRONG, "sales": [sale("2026-07-02")]}, strong(**PEAK)),
    "G-003": ({**STRONG, "sales": [sale("2026-05-20")]}, strong(**{**PEAK, "days": 90})),
    "G-004": ({**STRONG, "sales": [sale("2026-05-19")]}, strong(91, 89.246, 46.73, 96, 95.73, 0.27)),
    "G-005": ({**STRONG, "sales": [sale("2026-02-19")]}, strong(180, 40.005, 20.947, 70, 69.947, 0.053)),
    "G-006": ({**STRONG, "sales": [sale("2025-08-19")]}, strong(364, 0.103, 0.054, 49, 49.054, -0.054)),
    "G-007": ({**STRONG, "sales": [sale("2025-08-18")]}, strong(365)),
    "G-008": ({**STRONG, "sales": [sale("2026-07-02", 100.0)]}, strong(more=[NO_MOVE])),
    "G-009": ({**STRONG, "sales": [sale("2026-07-02", code="26")]}, strong(more=[NO_MOVE])),
    "G-010": ({**STRONG, "sales": [sale("2026-09-01")]}, strong(more=[NO_MOVE])),
    "G-011": ({**STRONG, "sales": [sale("2026-07-19", 1.0, source="MOD-IV"), sale("2026-02-19")]},
              strong(180, 40.005, 20.947, 70, 69.947, 0.053, more=[NO_MOVE])),
    "G-012": ({**STRONG, "sales": [sale("2026-07-02")], "registrations": ["2026-08-01"]},
              strong(**{**PEAK, "score": 71, "pre": 71.125}, rental=-25, more=[("rental_registration", -25)])),
    "G-013": ({**STRONG, "sales": [sale("2026-07-02")], "registrations": ["2026-06-01"]},
              strong(**PEAK, more=[("rental_stale", 0)])),
    "G-014": ({**STRONG, "sales": [sale("2026-07-02")], "rental": False}, strong(**PEAK, gaps=["rental_data_missing"])),
    "G-015": ({**QUIET, "permits": [permit("SDL-2026-101", "roof replacement", "2026-05-10", active="2026-06-15")]},
              quiet(15, [("fit_roof_age", 0), ("project_active", 15)], project=15)),
    "G-016": ({**QUIET, "permits": [permit("SDL-2004-033", "roof replacement", "2004-03-01", active="2004-03-01")]},
              quiet(0, [("fit_roof_age", 0), NEUTRAL])),
    "G-017": ({**QUIET, "permits": [HEATER]}, quiet(15, [("project_completed", 15)], project=15)),
    "G-018": ({**QUIET, "permits": [
        permit("SDL-2026-140", "addition - second story", "2026-05-01", active="2026-07-01"), HEATER,
        permit("SDL-2026-155", "boiler replacement", "2026-03-02", active="2026-06-15"),
        permit("SDL-2026-171", "irrigation system", "2026-04-06", active="2026-07-20")]},
        quiet(45, [("project_active", 15)] * 3 + [("project_completed", 15), ("project_cap_adjustment", -15)],
              project=45)),
    "G-019": ({**QUIET, "permits": [
        permit("SDL-2024-330", "water heater replacement", "2024-11-01", "completed", "2024-12-10"),
        permit("SDL-2024-330", "water heater replacement", "2024-11-01", "completed", "2024-12-10", source="statewide")]},
        quiet(15, [("project_completed", 15)], project=15)),
    "G-020": ({**QUIET, "permits": [
        permit("SDL-2025-777", "addition - family room", "2025-10-01", "voided"),
        permit("SDL-2026-050", "certificate of continued occupancy", "2026-02-01", "administrative")]},
        quiet(0, [NEUTRAL])),
    "G-021": ({**QUIET, "assessed": 650000.0, "acs": 0.36,
               "values": [*[500000.0 + 10000 * i for i in range(8)], 650000.0, 700000.0]},
              quiet(19, [("capacity_acs_dual_income_prior", 5), ("capacity_local_relative_value", 7),
                         ("capacity_territory_percentile", 7)], capacity=19)),
    "G-022": ({**QUIET, "assessed": 600000.0, "values": [400000.0, *[700000.0 + 10000 * i for i in range(10)]]},
              quiet(7, [("capacity_local_relative_value", 7)], capacity=7)),
    "G-023": ({**QUIET, "assessed": 900000.0, "comps": (9, 500000.0),
               "values": [*[400000.0 + 10000 * i for i in range(9)], 900000.0]},
              quiet(10, [("capacity_territory_percentile", 10)], capacity=10,
                    gaps=["local_comparables_insufficient"])),
    "G-024": ({**QUIET, "assessed": 900000.0, "comps": (20, 950000.0),
               "values": [*[400000.0 + 10000 * i for i in range(17)], 900000.0, 900000.0, 990000.0]},
              quiet(10, [("capacity_territory_percentile", 10)], capacity=10)),
    "G-025": ({**QUIET, "acs": 0.35}, quiet(5, [("capacity_acs_dual_income_prior", 5)], capacity=5)),
    "G-026": ({**QUIET, "permits": [
        permit("SDL-2025-090", "reroof - full replacement", "2025-01-20", "completed", "2025-02-15")]},
        quiet(15, [("fit_roof_age", 0), ("project_completed", 15)], project=15)),
    "G-027": ({**QUIET, "permits": [ROOF_2006]}, quiet(12, [("fit_roof_age", 12), NEUTRAL], fit=12)),
    "G-028": ({**QUIET, "permits": [permit("SDL-2006-200", "ROOF", "2006-05-01", "completed", "2006-06-20")]},
              quiet(0, [("fit_roof_age", 0), NEUTRAL])),
    "G-029": ({**QUIET, "year": 1951}, quiet(10, [("fit_home_age", 10)], fit=10)),
    "G-030": ({**QUIET, "year": 1946, "acres": 0.55, "permits": [ROOF_2006, permit(
        "SDL-2010-055", "solar panel installation", "2010-04-01", "completed", "2010-05-15")],
        "seen": {"decline": 0.7, "pool": 0.65}},
        quiet(48, [("fit_condition_decline", 8), ("fit_home_age", 10), ("fit_lot", 5), ("fit_pool", 8),
                   ("fit_roof_age", 12), ("fit_solar", 5), NEUTRAL], fit=48)),
    "G-031": ({**QUIET, "permits": [permit("SDL-2022-118", "siding replacement", "2022-04-01", "completed",
                                           "2022-06-01")], "seen": {"decline": 0.7}},
              quiet(0, [("fit_condition_superseded", 0), NEUTRAL])),
    "G-032": ({**QUIET, "permits": [permit("SDL-2015-088", "in-ground pool installation", "2015-05-01", "completed",
                                           "2015-07-10")], "seen": {"pool": 0.8}},
              quiet(8, [("fit_pool", 8), NEUTRAL], fit=8)),
    "G-033": ({**QUIET, "permits": [permit("SDL-2026-160", "solar panel installation", "2026-06-01",
                                           active="2026-07-10")]},
              quiet(15, [("project_active", 15)], project=15)),
    "G-034": ({**QUIET, "acres": 0.5}, quiet(5, [("fit_lot", 5)], fit=5)),
    "G-035": ({**QUIET, "year": 1946, "portal": False, "imagery": False, "sales": [sale("2026-07-02")]},
              line(fit=10, days=47, strength=90.0, lift=81.25, pre=91.25, adj=-0.25, score=91,
                   evidence=[("fit_home_age", 10), ("mover_recency", 81.25)],
                   gaps=["imagery_missing", "sdl_page_unavailable"], confidence="low")),
    "G-036": ({**QUIET, "registrations": ["2026-01-01"]},
              line(rental=-25, pre=-25.0, adj=25.0, score=0, evidence=[("rental_registration", -25)])),
    "G-037": ({**QUIET, "permits": [
        permit("SDL-2026-021", "addition - family room", "2026-01-05", "completed", "2026-06-01"), HEATER]},
        quiet(30, [("project_completed", 15)] * 2, project=30)),
    "G-038": ({**STRONG, "as_of": "2026-02-25", "sales": [sale("2026-02-19")]},
              line(15, 7, 23, 6, 90.0, 50.625, 0, 95.625, 0.375, 96,
                   [("capacity_local_relative_value", 7), ("fit_home_age", 10), ("fit_lot", 5), ("fit_roof_age", 8),
                    ("mover_recency", 50.625), ("project_completed", 15)])),
    # Identity keys on the input have no column to land in.
    "G-039": ({**QUIET, "year": 1951, "owner_name": "JANE Q PUBLIC", "mailing_address": "PO BOX 7"},
              quiet(10, [("fit_home_age", 10)], fit=10)),
    "G-040": ({**QUIET, "assessed": 650000.0, "portal_assessed": 990000.0},
              quiet(7, [("capacity_local_relative_value", 7)], capacity=7)),
    "G-041": ({**QUIET, "assessed": None, "portal_assessed": 650000.0, "values": STRONG["values"]},
              quiet(7, [("capacity_local_relative_value", 7)], capacity=7)),
    "G-042": ({**QUIET, "permits": [permit("SDL-2025-411", "water heater replacement", "2025-06-01", "completed")]},
              quiet(15, [("project_completed", 15)], project=15)),
}


def day(text):
    return dt.date.fromisoformat(text) if text else None


def frames(spark, cases=None):
    """All cases as the tables the engine takes; each case is its own territory with one subject door."""
    from pyspark.sql import functions as F

    from doorlens.scoring.facts import assessed_value

    rows = {name: case for name, (case, _) in (cases or CASES).items()}

    def frame(schema, values):
        return spark.createDataFrame(list(values), schema)

    key = "territory_id string, pams_pin string, "
    doors = frame(
        key + "as_of date, net_value double, portal_total string, portal_exact boolean, construction_year int, "
        "lot_acres double, dual_income_pct double, sdl_page_available boolean, rental_available boolean, "
        "imagery_available boolean",
        ((n, n, day(c["as_of"]), c["assessed"], None if c["portal_assessed"] is None else str(c["portal_assessed"]),
          c["portal_assessed"] is not None, c["year"], c["acres"], c["acs"], c["portal"], c["rental"], c["imagery"])
         for n, c in rows.items()),
    ).withColumn("assessed_value", assessed_value(F.col("net_value"), F.col("portal_total"), F.col("portal_exact")))
    sales = frame(
        key + "ordinal bigint, source string, sale_day date, sale_price double, sales_code string",
        ((n, n, i, s["source"], day(s["day"]), s["price"], s["code"])
         for n, c in rows.items() for i, s in enumerate(c["sales"])),
    )
    permits = frame(
        key + "permit_id string, municipal_id string, description string, work_type string, disposition string, "
        "issue_date date, completion_date date, last_activity_date date, from_portal boolean, from_statewide boolean, "
        "ordinal bigint",
        ((n, n, f"{n}-{i}", p["municipal_id"], p["description"], None, p["state"], day(p["issue"]), day(p["done"]),
          day(p["active"]), p["source"] == "SDL", p["source"] != "SDL", i)
         for n, c in rows.items() for i, p in enumerate(c["permits"])),
    )
    comparables = frame(
        key + "comp_pin string, value double, distance_m double, rank int",
        ((n, n, f"c{i}", c["comps"][1], 50.0 + i, i + 1) for n, c in rows.items() for i in range(c["comps"][0])),
    )
    values = frame("territory_id string, value double", ((n, v) for n, c in rows.items() for v in c["values"]))
    rental = frame(key + "reg_date date", ((n, n, day(d)) for n, c in rows.items() for d in c["registrations"]))
    observed = frame(
        key + "pool_confidence double, solar_confidence double, decline_confidence double",
        ((n, n, c["seen"].get("pool"), c["seen"].get("solar"), c["seen"].get("decline"))
         for n, c in rows.items() if c["seen"]),
    )
    return {"doors": doors, "sales": sales, "permits": permits, "comparables": comparables, "values": values,
            "rental": rental, "observed": observed}
