"""Resolution, imagery, publishing and outcomes on hand rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import contract_cases as cc
from doorlens.operators import history, imagery, outcomes, permits, publish, report, resolve
from doorlens.scoring.engine import score

AS_OF = dt.date(2026, 8, 18)
PARCEL = "territory_id int, mun string, pams_pin string, block string, lot string, qualifier string, address string, zip5 string, " \
         "deed_date string, sale_price double, sales_code string, prop_class string, geoid string, territory_rank long, lon double, lat double"
PERMIT = "mun string, record_id string, block string, lot string, address string, permit_date date"
SALE = "mun string, block string, lot string, qualifier string, deed_date string, date_recorded string, sale_price double, nu_code string, ordinal long"


@pytest.fixture(scope="module")
def town(spark):
    def parcel(pin, block, lot, address, deed="200101", qualifier="", rank=0, geoid="g1"):
        return (1, "0248", pin, block, lot, qualifier, address, "07446", deed, 400000.0, "", "2", geoid, rank, -74.0, 41.0)

    parcels = [parcel("A", "1", "1", "1 Oak St", rank=0), parcel("B", "01", "1.0", "2 Oak St", rank=1),
               parcel("C", "1", "2", "3 Oak St", deed=None, rank=2), parcel("D", "2", "1", "9 Elm Ave", qualifier="c1", rank=3),
               parcel("E", "2", "1", "9 Elm Ave Apt 2", qualifier="C2", rank=4, geoid="none")]
    day = dt.date(2026, 5, 1)
    rows = [("0248", "1", "0001", "01", None, day), ("0248", "2", "1", "77", "3 OAK STREET", day),
            ("0248", "3", "1", "77", "9 Elm Ave", day), ("0248", "4", "1", "77", "1 Nowhere", day), ("0248", "5", "1", "77", None, day),
            ("0248", "6", "99", "1", None, day), ("0248", "7", "00", "0", None, day), ("0248", "8", "1", "2", None, None),
            ("0248", "9", "1", "2", None, AS_OF - dt.timedelta(days=730)), ("0248", "10", "1", "2", None, AS_OF - dt.timedelta(days=731)),
            ("0248", "11", "1", "2", " # ", day)]
    sales = [("0248", "1", "1", "", "260101", "260110", 1.0, "04 ", 1), ("0248", "1", "1", "", "251231", "260301", 9e5, "", 2),
             ("0248", "1", "2", "", "190101", "190101", 5e5, "", 3), ("0248", "2", "1", "C1", "200101", "200101", 7e5, "", 4),
             ("0248", "2", "1", "C2", "", "260101", 8e5, "", 5)]
    return {
        "territory": spark.createDataFrame(parcels, PARCEL), "permits": spark.createDataFrame(rows, PERMIT),
        "sales": spark.createDataFrame(sales, SALE),
        "acs": spark.createDataFrame([("g1", 0.4)], "geoid string, dual_income_pct double"),
        "registry": spark.createDataFrame([(" D ",)], "pams_pin string"), "as_of": AS_OF,
    }


def run(town, shuffle=None):
    inputs = dict(town)
    if shuffle is not None:
        for name in ("territory", "permits", "sales"):
            inputs[name] = inputs[name].orderBy(F.rand(shuffle)).repartition(3)
    return resolve.resolve(**inputs)


def test_resolution(town):
    out = run(town)
    doors = {r.pams_pin: r for r in out["doors"].collect()}
    assert {p: d.deed.source for p, d in doors.items()} == {
        "A": resolve.SOURCE_SR1A, "B": resolve.SOURCE_SR1A, "C": resolve.SOURCE_SR1A, "D": resolve.SOURCE_MODIV, "E": resolve.SOURCE_MODIV}
    a = doors["A"].deed
    assert (a.deed_day, a.price, a.sales_code) == (dt.date(2026, 1, 1), 1.0, "04")
    assert doors["D"].is_rental and not doors["A"].is_rental
    assert doors["A"].situs == "1 Oak St, Ramsey NJ 07446"
    assert set(doors["A"].provenance) == {"parcel", "sales", "permits", "acs"}
    assert set(doors["E"].provenance) == {"parcel"}
    assert [(r.pams_pin, r.position) for r in out["permits"].orderBy("pams_pin", "position").collect()] == [
        ("A", 0), ("C", 0), ("C", 1), ("C", 2)]
    assert [r.record_id for r in out["permits"].filter("pams_pin = 'C'").orderBy("position").collect()] == ["2", "11", "9"]
    reasons = {r.record_id: r.reason for r in out["unmatched"].collect()}
    assert reasons == {"3": resolve.REASON_ADDRESS_AMBIGUOUS, "4": resolve.REASON_ADDRESS_UNKNOWN, "5": resolve.REASON_NO_PARCEL}
    report_row = out["report"].first()
    assert (report_row.permits_total, report_row.permits_out_of_window, report_row.permits_out_of_territory) == (11, 2, 2)
    assert (report_row.matched_by_block_lot, report_row.matched_by_address, report_row.permits_unmatched) == (3, 1, 3)
    assert (report_row.permits_matched_municipal, report_row.permits_placeholder_block_lot, report_row.permits_unmatched_municipal) == (3, 1, 5)
    assert report_row.permit_match_rate == pytest.approx(4 / 7) and report_row.coverage == pytest.approx(4 / 5)


def test_resolution_ignores_input_order(town):
    def shape(seed):
        out = run(town, seed)
        return {n: sorted(str(r) for r in out[n].drop("provenance").collect()) for n in ("doors", "permits", "unmatched", "report")}

    assert shape(1) == shape(2)


def test_no_parcels_no_division(spark, town):
    nothing = town["permits"].filter("false")
    routed = resolve.route_permits(nothing, town["territory"], town["territory"], AS_OF)
    rates = resolve.match_rates(resolve.permit_accounting(town["permits"].filter("record_id = '8'"), routed)).first()
    assert (rates.permit_match_rate, rates.municipal_match_rate, rates.permits_out_of_window) == (0.0, 0.0, 1)


# --- permits of three sources ----------------------------------------------------------------


def test_coalesced_permits(spark):
    apps = spark.createDataFrame(
        [(1, "p", 0, "M1", "Amendment", "first", "Open", "1/1/2020", ""), (1, "p", 1, "M1", "New", "", "Closed with Date", "2/1/2020", "3/1/2020"),
         (1, "p", 2, "M1", "supplement", "later", "Open", "4/1/2020", ""), (1, "p", 3, "M2", "Amendment", "only", "Stale", "5/1/2020", "")],
        "territory_id int, pams_pin string, ordinal long, permit_number string, work_type string, work_description string, "
        "status string, issue_date string, close_date string")
    roof = spark.createDataFrame(
        [(1, "p", 0, "M1", "RE-ROOF", "Alt", "voided", dt.date(2019, 1, 1), "u"), (1, "p", 1, "R9", "new roof", "Alt", "completed", dt.date(2005, 1, 1), "u")],
        "territory_id int, pams_pin string, ordinal long, municipal_id string, description string, work_type string, disposition string, "
        "issue_date date, detail_url string")
    state = spark.createDataFrame(
        [(1, "p", 0, "M1", "state", dt.date(2020, 6, 6), dt.date(2020, 7, 7)), (1, "p", 1, "S5", "state", dt.date(2021, 6, 6), None),
         (1, "p", 2, "S6", "same day", dt.date(2005, 1, 1), None), (1, "p", 3, "S7", "undated", None, None)],
        "territory_id int, pams_pin string, ordinal long, municipal_id string, description string, issue_date date, completion_date date")
    got = {r.municipal_id: r for r in permits.coalesce_permits(apps, roof, state).collect()}
    assert set(got) == {"M1", "M2", "R9", "S5", "S7"}
    m1 = got["M1"]
    assert (m1.description, m1.work_type, m1.disposition, m1.issue_date, m1.completion_date, m1.amendments) == (
        "RE-ROOF", "New", "completed", dt.date(2020, 2, 1), dt.date(2020, 3, 1), 2)
    assert m1.from_portal and m1.from_statewide and m1.statewide_issue_date == dt.date(2020, 6, 6)
    assert (got["M2"].description, got["M2"].disposition) == ("only", "expired")
    assert got["S5"].issue_date is None and not got["S5"].from_portal
    order = [r.municipal_id for r in permits.coalesce_permits(apps, roof, state).orderBy("origin", "ordinal").collect()]
    assert order == ["M1", "M2", "R9", "S5", "S7"]


# --- imagery ---------------------------------------------------------------------------------------


def test_answers_to_signals(spark):
    ref = "https://t/export?bbox=1%2C2%2C3%2C4&f=image"
    tiles = spark.createDataFrame([(1, "p", ref, "2015-01-01"), (1, "p", "new", "2020-01-01")],
                                  "territory_id int, pams_pin string, image_ref string, capture_date string")

    def answer(*rows):
        return json.dumps({"detections": list(rows)})

    def row(signal="pool", present=True, confidence=0.9, image_ref=ref):
        return {"image_ref": image_ref, "signal": signal, "present": present, "confidence": confidence}

    texts = [answer(row(), row(confidence=0.59, present=False)), "```json\n" + answer(row("condition_good", confidence=1)) + "\n```",
             answer(row("condition_poor", image_ref="new", confidence=0.8)), "sorry", "[]", answer("x", row(present=1), row(confidence=True),
             row(confidence="0.9"), row(confidence=1.01), row("garage"), row(image_ref="elsewhere"), row(image_ref=None)), '{"detections": {}}', ""]
    responses = spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "batch_id string, ordinal long, response string")
    valid, bad = imagery.detections_from(responses, tiles)
    assert valid.count() == 4
    counts = {r.reason: r["count"] for r in bad.groupBy("reason").count().collect()}
    assert counts == {imagery.REASON_ENVELOPE: 4, imagery.REASON_NOT_OBJECT: 1, imagery.REASON_PRESENT: 1, imagery.REASON_CONFIDENCE: 3,
                      imagery.REASON_SIGNAL: 1, imagery.REASON_NOT_IN_BATCH: 2}
    signals = imagery.imagery_signals(valid, order=("ordinal", "row_number"))
    s = signals.first()
    assert (s.pool, s.solar, s.condition_2015, s.condition_2020, s.declined) == (True, False, "good", "poor", True)
    assert s.condition_frame.image_ref == "new"
    seen = imagery.observations(signals).first()
    assert (seen.pool_confidence, seen.solar_confidence, seen.decline_confidence) == (0.9, None, 1.0)
    evidence = spark.createDataFrame([(1, "p", "fit_pool"), (1, "p", "fit_condition_decline"), (1, "p", "fit_lot")],
                                     "territory_id int, pams_pin string, type string")
    framed = {r.type: r.imagery for r in imagery.attach_frames(evidence, signals).collect()}
    assert json.loads(framed["fit_pool"]) == {"bbox": [1.0, 2.0, 3.0, 4.0], "capture_date": "2015-01-01", "image_url": ref, "model_confidence": 0.9}
    assert framed["fit_condition_decline"] is None and framed["fit_lot"] is None


def test_a_batch_only_answers_for_its_own_tiles(spark):
    tiles = spark.createDataFrame([(1, "p", "a", "2015-01-01"), (1, "q", "b", "2015-01-01")],
                                  "territory_id int, pams_pin string, image_ref string, capture_date string")
    sent = spark.createDataFrame([("one", "a"), ("two", "b")], "batch_id string, image_ref string")
    text = json.dumps({"detections": [{"image_ref": "b", "signal": "pool", "present": True, "confidence": 0.7}]})
    responses = spark.createDataFrame([("one", 0, text), ("two", 1, text)], "batch_id string, ordinal long, response string")
    valid, bad = imagery.detections_from(responses, tiles, sent)
    assert [r.batch_id for r in valid.collect()] == ["two"] and [r.batch_id for r in bad.collect()] == ["one"]


# --- publishing ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def published(spark):
    out = score(**cc.frames(spark))
    resolved = out["doors"].select(
        "territory_id", "pams_pin", F.concat(F.lit("1 Oak St, "), F.col("pams_pin")).alias("situs"),
        F.when(F.col("pams_pin") == "G-001", publish.EXCLUSION_REASON).alias("exclusion_reason"))
    doors = publish.doors_table(resolved, out["doors"])
    return out, doors, publish.evidence_table(out["evidence"], doors)


def test_published_tables(published, tmp_path, spark):
    out, doors, evidence = published
    assert doors.columns == ["territory_id", *publish.DOOR_COLUMNS]
    hidden = doors.filter("pams_pin = 'G-001'").first()
    assert (hidden.score, hidden.exclusion_reason, hidden.score_contract_version) == (None, publish.EXCLUSION_REASON, "v2")
    assert evidence.filter("pams_pin = 'G-001'").count() == 0 and evidence.filter("pams_pin = 'G-002'").count() == 6
    for _ in range(2):
        publish.write_tables(doors, evidence, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "doors")).count() == 42
    assert publish.schema_findings("doors", doors.schema) == []
    assert publish.schema_findings("t", doors.select(F.struct(F.lit(1).alias("ownerName")).alias("x"), F.lit(1).alias("reagent")).schema) == [
        "t.x.ownerName"]
    totals = publish.coverage(doors.withColumn("all", F.lit(1)), by="all").first()
    assert (totals.doors_total, totals.doors_scored) == (42, 41)
    assert report.unreconciled(out["doors"], out["evidence"]).count() == 0


def test_features(published, spark):
    _, doors, evidence = published
    shape = spark.createDataFrame([("G-002", "G-002", [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]])],
                                  "territory_id string, pams_pin string, polygon array<array<array<array<double>>>>")
    rows = {r.pams_pin: json.loads(r.feature) for r in publish.door_features(doors, evidence, shape).collect()}
    two, one = rows["G-002"], rows["G-001"]
    assert len(rows) == 42 and one["geometry"] is None and one["properties"]["score"] is None and one["properties"]["evidence"] == []
    assert two["geometry"]["type"] == "MultiPolygon" and two["properties"]["categories"] == {"project": 15, "capacity": 7, "fit": 27}
    assert set(two["properties"]) == {
        "PAMS_PIN", "score", "confidence", "evidence", "situs", "exclusion_reason", "score_contract_version", "categories", "base",
        "mover", "mover_lift", "rental_modifier", "adjustment", "data_gaps"}
    parcel = spark.createDataFrame([(1, 1, None), (1, 2, [[[[0.0, 0.0]]]])], "territory_id int, territory_rank int, polygon array<array<array<array<double>>>>")
    for name in publish.TERRITORY_PROPERTIES:
        parcel = parcel.withColumn(name, F.lit("x"))
    lines = publish.territory_features(parcel).collect()
    assert len(lines) == 1 and set(json.loads(lines[0].feature)["properties"]) == set(publish.TERRITORY_PROPERTIES)


def test_manifest_and_report(published, spark):
    out, doors, evidence = published
    one = doors.withColumn("territory_id", F.lit(1))
    facts = spark.createDataFrame([(1, 11, 0.5)], "territory_id int, permits_total int, permit_match_rate double")
    vintage = spark.createDataFrame([(1, dt.date(2026, 7, 1))], "territory_id int, latest_deed_date date")
    lost = spark.createDataFrame([("no acs key",), ("no acs key",)], "reason string")
    row = publish.run_manifest(one, facts, vintage, AS_OF, "2026-08-18T00:00:00Z", "abc", degradations=lost).first()
    body = json.loads(row.manifest)
    assert (body["doors_total"], body["doors_scored"], body["degradations"]) == (42, 41, ["no acs key"])
    assert body["resolve"] == {"permits_total": 11, "permit_match_rate": 0.5} and body["deed_vintage"] == {"latest_deed_date": "2026-07-01"}
    gaps = out["gaps"].withColumn("territory_id", F.lit(1))
    built = report.score_report(one, evidence.withColumn("territory_id", F.lit(1)), gaps).first()
    assert built.score_max == 96.0 and built.missing_signals["imagery_missing"] == 1 and built.stale_open_neutralized == 7


def test_manifest_blocks(published, spark):
    _, doors, _ = published
    two = doors.withColumn("territory_id", F.lit(1)).unionByName(doors.withColumn("territory_id", F.lit(2)))
    facts = spark.createDataFrame([(1, 11), (2, 12)], "territory_id int, permits_total int")
    vintage = spark.createDataFrame([(1, dt.date(2026, 7, 1), dt.date(2026, 6, 1), 3)], "territory_id int, latest_deed_date date, latest_sale_date date, doors_in_mover_window int")
    register = spark.createDataFrame([(1, ["b.txt"], 4)], "territory_id int, source_files array<string>, doors_superseding_modiv int")
    retrieved = spark.createDataFrame([(1, "deeds", dt.date(2026, 5, 1)), (1, "deeds", dt.date(2026, 5, 9)), (1, "acs", dt.date(2026, 1, 1))], "territory_id int, source string, retrieved date")
    vision = spark.createDataFrame([(1, False, "no key", 0, 0, 0)], "territory_id int, available boolean, declination_reason string, answers_total int, answers_lost int, doors_with_imagery int")
    lost = spark.createDataFrame([(2, "b"), (2, "a"), (2, "a")], "territory_id int, reason string")
    rows = publish.run_manifest(two, facts, vintage, AS_OF, "2026-08-18T00:00:00Z", "abc", degradations=lost, retrieved=retrieved, vision=vision, register=register)
    one, other = (json.loads(r.manifest) for r in rows.orderBy("territory_id").collect())
    assert one["retrieved"] == {"acs": "2026-01-01", "deeds": "2026-05-09"} and other["retrieved"] is None
    assert one["deed_vintage"] == {
        "latest_deed_date": "2026-07-01", "doors_in_mover_window": 3, "mover_window_days": 90,
        "sales_register": {"latest_sale_date": "2026-06-01", "source_files": ["b.txt"], "doors_superseding_modiv": 4}}
    assert other["deed_vintage"]["sales_register"] == {"latest_sale_date": None, "source_files": [], "doors_superseding_modiv": 0}
    assert one["vision"]["declination_reason"] == "no key" and one["vision"]["available"] is False and other["vision"] is None
    assert one["degradations"] == [] and other["degradations"] == ["a", "b"]


def test_chips_and_panel_terms(published):
    out, _, evidence = published
    chips = {r.pams_pin: r.reason_chip for r in publish.reason_chips(evidence).collect()}
    assert chips["G-002"] == "mover_recency" and chips["G-030"] == "fit_roof_age" and "G-022" not in chips
    shown = {r.pams_pin: r for r in publish.rounded_breakdown(out["doors"]).collect()}
    assert all(r.shown_base + r.shown_lift + r.shown_rental + r.shown_adjustment == r.score for r in shown.values())
    assert shown["G-036"].clamp == "floor" and shown["G-002"].clamp is None


# --- histories and outcomes ---------------------------------------------------------------------------


def test_private_fields_go(spark):
    df = spark.sql("select map('Owner', '1', 'AGENT', '2', 'agent_count', '3', 'roof', '4') as m")
    assert df.select(history.strip_private(F.col("m")).alias("m")).first().m == {"agent_count": "3", "roof": "4"}


def test_private_fields_go_at_any_depth(spark):
    df = spark.sql("""select 1 as id, 'x' as OWNER, named_struct('agent', 'a', 'keep', array(named_struct('Mailing', 'm', 'roof', 1)),
        'more', map('permit_agent', named_struct('z', 1), 'ok', named_struct('z', 2))) as page""")
    assert history.without_private(df).first().asDict(recursive=True) == {
        "id": 1, "page": {"keep": [{"roof": 1}], "more": {"ok": {"z": 2}}}}


def test_a_property_with_many_permits_is_one_record(spark):
    key = "territory_id int, pams_pin string, "
    permits_ = spark.createDataFrame([(1, "p", i, f"u{i}", str(i), None, "property_page", None) for i in range(5000)],
                                     key + "ordinal long, detail_url string, permit_number string, work_description string, "
                                     "source_scope string, roof_detail string")
    doors = spark.createDataFrame([(1, "p"), (1, "q")], "territory_id int, pams_pin string")
    pages = spark.createDataFrame([(1, "p", "collected")], key + "collection_status string")
    rows = history.property_history(doors, pages, permits_).orderBy("pams_pin").collect()
    assert [(r.pams_pin, len(r.permits), r.collection_status) for r in rows] == [("p", 5000, "collected"), ("q", 0, "not_collected")]
    assert [x.ordinal for r in rows for x in r.permits] == list(range(5000))


def test_history_documents_have_every_block_and_no_private_field(spark):
    doors = spark.createDataFrame([(1, "p", "1", "2", " 5 Oak Street "), (1, "q", None, None, None)], "territory_id int, pams_pin string, block string, lot string, address string")
    pages = spark.sql("""select 1 as territory_id, 'p' as pams_pin, 'collected' as collection_status, named_struct('total', '$5', 'owner', 'x') as assessed_valuation,
        named_struct('inspections', array(named_struct('agent', 'y', 'n', 1))) as construction""")
    permits_ = spark.createDataFrame([], "territory_id int, pams_pin string, ordinal long, detail_url string, permit_number string, "
                                         "work_description string, source_scope string, roof_detail string")
    rows = history.history_documents(history.property_history(doors, pages, permits_)).orderBy("pams_pin").collect()
    first, second = (json.loads(r.document) for r in rows)
    assert (first["block"], first["address"], first["normalized_address"]) == ("1", "5 Oak Street", "5 OAK ST")
    assert first["assessed_valuation"] == {"total": "$5"} and first["construction"] == {"permit_applications": [], "inspections": [{"n": 1}], "violations": []}
    assert (second["block"], second["address"], second["collection_status"]) == ("", "", "not_collected")
    assert all(second[b] == {} for b in history.PAGE_BLOCKS) and set(first) == set(second)


def test_page_identity(spark):
    urls = ["https://x/t/properties/22.01/4", "https://x/properties/properties/a%20b/7?q=1", "https://x/properties/1", "https://x/properties/1/2/3", ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = [r.p for r in df.select("i", history.path_identity(F.col("u")).alias("p")).orderBy("i").collect()]
    assert [tuple(p) if p else None for p in got] == [("22.01", "4"), ("a b", "7"), None, None, None]
    with pytest.raises(ValueError):
        history.require_no_violations(spark.createDataFrame([("p", "outside territory")], "pams_pin string, violation string"))


def test_band_lift_lists_empty_bands(spark):
    rows = [("d", "2026-01-01T10:00:00", "v2", s, o, True, False) for s, o in ((10, "receptive_conversation"), (20, "no_answer"), (20, "receptive_conversation"))]
    df = spark.createDataFrame(rows, "door_id string, attempt_time string, score_contract_version string, attempt_score int, "
                                     "primary_outcome string, follow_up_requested boolean, service_booked boolean")
    valid, invalid = outcomes.validate_outcomes(df)
    assert invalid.count() == 0
    got = [(r.band, r.attempts, r.receptive_rate, r.follow_up_rate) for r in outcomes.band_lift(valid, [20, 50]).orderBy("band").collect()]
    assert got == [(0, 1, 1.0, 1.0), (1, 2, 0.5, 1.0), (2, 0, 0.0, 0.0)]
    with pytest.raises(ValueError):
        outcomes.band_lift(valid, [50, 20])


def test_one_door_with_most_permits(spark):
    from doorlens.scoring import engine

    frames = cc.frames(spark, {name: cc.CASES[name] for name in ("G-017", "G-021")})
    many = spark.range(3000).select(
        F.lit("G-017").alias("territory_id"), F.lit("G-017").alias("pams_pin"), F.concat(F.lit("hot"), F.col("id").cast("string")).alias("permit_id"),
        F.concat(F.lit("H-"), F.col("id").cast("string")).alias("municipal_id"), F.lit("roof repair").alias("description"), F.lit(None).cast("string").alias("work_type"),
        F.lit("completed").alias("disposition"), F.lit("2026-01-01").cast("date").alias("issue_date"), F.lit(None).cast("date").alias("completion_date"),
        F.lit(None).cast("date").alias("last_activity_date"), F.lit(True).alias("from_portal"), F.lit(False).alias("from_statewide"),
        (F.col("id") * 1_000_003 + 10).alias("ordinal"))
    frames["permits"] = frames["permits"].unionByName(many).repartition(6)
    out = engine.score(**frames)
    door = out["doors"].filter("pams_pin = 'G-017'").first()
    assert (door.project, door.score) == (45, 45)
    rows = out["evidence"].filter("pams_pin = 'G-017'").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(3003)) and sum(r.points for r in rows) == 45
    assert rows[3001].type == "project_cap_adjustment" and rows[3001].points == 45 - 15 * 3001
    assert rows[3002].reason.startswith("3000 roof-related permit records on file (roof repair, issued 2026-01-01; ")
    assert rows[3002].reason.endswith("; and 2997 more), but none establish a completed installation age")


def test_a_base_blended_down_reconciles(spark):
    """A base of 106 with a fresh sale falls to 103.25 and has no entry for it; a point too many is still found."""
    doors = spark.createDataFrame([(1, "a", -2.75, 103.25, -3.25, 100), (1, "b", -2.75, 103.25, -3.25, 100), (1, "c", 9.0, 19.0, 0.0, 19)],
                                  "territory_id int, pams_pin string, mover_lift double, pre_rounding double, adjustment double, score int")
    evidence = spark.createDataFrame([(1, "a", 106.0), (1, "b", 107.0), (1, "c", 10.0)], "territory_id int, pams_pin string, points double")
    assert {r.pams_pin for r in report.unreconciled(doors, evidence).collect()} == {"b", "c"}
