from oracle import check

from keyloom.llm import license_texts, licenses
from keyloom.llm.queries import ORACLE, QUERIES


def test_agrees_with_sql(spark, sf):
    check(spark, QUERIES["op6_licenses"], ORACLE["op6_licenses"], sf)


def test_edges(spark):
    fill = " ".join(f"w{i}" for i in range(3000))
    data = [
        (1, None, "s"), (2, "", "s"), (3, "!! -- ", "s"), (4, "MIT license mit LICENSE", "s"), (4, "MIT license mit LICENSE", "s"),
        (5, fill + " Licensed under CC BY-NC 4.0 " + fill, "s"), (6, "general public", "s"), (7, "mit license", "s"), (None, "the Apache License", "s"),
        (8, "x " * 30 + "permission is hereby granted, free of charge, to any person obtaining a copy of this software", "s"),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, labels string")
    got = sorted((tuple(r)[:8] for r in licenses.scan(df).collect()), key=repr)
    assert got == sorted(
        [
            (1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0),
            (4, 4, 2, 0, 2, "mit", "mit", 1.0), (4, 4, 2, 0, 2, "mit", "mit", 1.0), (5, 6007, 0, None, None, "", "cc", 1.0),
            (6, 2, 0, None, None, "", "", 0.0), (7, 1, 0, None, None, "", "", 0.0), (None, 3, 1, 1, 1, "apache", "apache", 1.0),
            (8, 46, 0, None, None, "", "mit", 15 / 19),
        ],
        key=repr,
    )
    assert licenses.scan(df.limit(0)).count() == 0


def test_bodies_and_sentences_that_are_none(spark):
    fill = " ".join(f"w{i}" for i in range(777))
    bodies = [(label, f"{fill} {t} {fill}") for label, texts in license_texts.BODIES.items() for t in texts]
    none = [
        "This work by Ann is licensed under a commercial license; attribution is required",
        "You may use this file in compliance with the policy, except on Sundays, and you may not use the license of others",
        "The software is provided without charge to any person of this company, a copy of which is hereby granted free use",
        "Redistribution of wealth in source and binary systems, with or without use, is permitted",
    ]
    df = spark.createDataFrame([*bodies, *(("", t) for t in none)], "want string, text string")
    for r in licenses.scan(df, keep=("want", "text")).collect():
        assert r.labels.split(",") == [r.want] or (r.want in ("agpl", "gpl", "unlicense", "mit") and r.want in r.labels.split(",")), r


def test_whole_plan_is_native(spark, sf):
    plan = QUERIES["op6_licenses"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapPartitions"))
