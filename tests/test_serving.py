from kestrel.operators import serving as S

FIELDS = ("latency", "size", "hops")


def record(**changes):
    """JSON text of a good record; a value given as text is put in as it stands, None leaves it out."""
    cells = {"latency": "0.75", "size": "1400", "hops": "6"} | changes
    return "{" + ", ".join(f'"{k}": {v}' for k, v in cells.items() if v is not None) + "}"


CASES = [
    (record(), "valid", []),
    (record(size=None), "schema_mismatch", ["size"]),
    (record(ttl="64"), "schema_mismatch", ["ttl"]),
    (record(size=None, ttl="64"), "schema_mismatch", ["size", "ttl"]),
    (record(hops='"six"'), "invalid_value", ["hops:not_numeric"]),
    (record(hops="[6]"), "invalid_value", ["hops:not_numeric"]),
    (record(latency="false"), "invalid_value", ["latency:boolean_not_numeric"]),
    (record(latency="NaN"), "invalid_value", ["latency:not_finite"]),
    (record(latency="-4e400", size='""'), "invalid_value", ["latency:not_finite", "size:not_numeric"]),
    (record()[:-1], "malformed_json", []),
    ('{"latency": 1, "size": 2, "hops": 3, "hops": 3}', "malformed_json", []),
    ("[0.75, 1400, 6]", "invalid_record", []),
]


def test_record_validation(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, p string")
    got = {r["i"]: r for r in S.validate_features(df, "p", FIELDS).collect()}
    for i, (text, category, named) in enumerate(CASES):
        r = got[i]
        assert r["validation_category"] == category, text
        said = [*(r["missing_fields"] or []), *(r["unexpected_fields"] or []), *(r["invalid_fields"] or [])]
        assert sorted(said) == sorted(named), text
        assert (r["features_typed"] is not None) == (category == "valid")
    assert tuple(got[0]["features_typed"]) == (0.75, 1400.0, 6.0)


def test_batch_verdicts(spark):
    rows = [(7, 0, record()), (7, 1, record(hops="null")), (7, 2, "?"), (8, 0, record()), (9, 0, record()), (9, 1, record()),
            (9, 2, record()), (9, 3, record())]
    v = S.validate_features(spark.createDataFrame(rows, "batch int, idx int, p string"), "p", FIELDS)
    out = {r["batch"]: (r["batch_status"], r["bad_indexes"]) for r in S.validate_batch(v, "batch", "idx", 3).collect()}
    assert out == {7: ("batch_validation_failed", [1, 2]), 8: ("accepted", []), 9: ("batch_too_large", [])}


def test_label_merge_f17(spark):
    preds = spark.createDataFrame([("p1",), ("p2",)], "prediction_id string")
    labels = spark.createDataFrame([("p1", 1, 1, 0), ("p1", 1, 2, 0), ("p1", 0, 3, 0), ("missing", 1, 4, 0)],
                                   "prediction_id string, label int, arrival int, seq int")
    st = {(r.prediction_id, r.arrival): (r.status, r.retryable) for r in S.merge_labels(labels, preds).collect()}
    assert st[("p1", 1)] == ("recorded", False)
    assert st[("p1", 2)] == ("idempotent", False)
    assert st[("p1", 3)] == ("conflict", False)
    assert st[("missing", 4)] == ("unknown", True)


def test_batch_labels_all_or_nothing(spark):
    preds = spark.createDataFrame([("p1",), ("p2",)], "prediction_id string")
    labels = spark.createDataFrame([(1, "p1", 1), (1, "p2", 0), (2, "p1", 1), (2, "p1", 0), (3, "p1", 1), (3, "x", 1)],
                                   "batch_id int, prediction_id string, label int")
    out = {r.batch_id: r.batch_status for r in S.batch_label_verdict(labels, preds).collect()}
    assert out == {1: "applied", 2: "conflict", 3: "unknown"}


QUEUE = [
    ('{"prediction_id": "q-77", "at": 5}', "valid"), (' {"prediction_id": 12}\t', "valid"), ('{"prediction_id": "0"}', "valid"),
    ('{"prediction_id": "q-77"}', "valid"), ('{"prediction_id": [1]}', "valid"),
    ("", "blank"), (" \t ", "blank"),
    ('{"prediction_id": 0}', "malformed"), ('{"prediction_id": 0.0}', "malformed"), ('{"prediction_id": false}', "malformed"),
    ('{"prediction_id": null}', "malformed"), ('{"prediction_id": ""}', "malformed"), ('{"prediction_id": {}}', "malformed"),
    ('{"id": "q-78"}', "malformed"), ('["q-79"]', "malformed"), ('"q-80"', "malformed"), ("prediction_id=q-81", "malformed"),
]


def test_queue_lines_and_drain(spark):
    lines = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(QUEUE)], "line_no int, value string")
    q = S.scan_jsonl_queue(lines)
    assert {r["line_no"]: r["line_status"] for r in q.collect()} == {i: k for i, (_, k) in enumerate(QUEUE)}
    for stored, new in (([], 4), ([("q-77",), ("12",)], 2)):
        rep = S.drain_queue(q, spark.createDataFrame(stored, "prediction_id string")).first()
        assert (rep["attempted"], rep["persisted"], rep["malformed"], rep["blank"]) == (5, new, 10, 2)


def test_observation_validation(spark):
    df = spark.createDataFrame([("p1", 1, "1", "valid"), ("p2", 2, "1", "valid"), ("p3", 0, None, "valid"),
                                ("p4", 1, "1", "schema_mismatch")],
                               "prediction_id string, ground_truth int, model_version string, validation_category string")
    out = {r.prediction_id: (r.validation_status, r.validation_errors) for r in S.validate_observation(df).collect()}
    assert out["p1"] == ("approved", [])
    assert out["p2"] == ("rejected", ["invalid_ground_truth"])
    assert out["p3"] == ("rejected", ["missing_source_model_version"])
    assert out["p4"] == ("rejected", ["feature_schema_validation_failed"])
