import textwrap

import duckdb

from tagweave.llm import licences
from tagweave.llm.licence_values import RULES, SENTENCES


def scanned(spark, texts: list) -> dict:
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, ids string, line int")).collect()}


def test_each_rule_holds_for_its_sentences_in_order_and_not_turned(spark):
    first = {}
    for name, sentence in SENTENCES:
        first.setdefault(name, sentence)
    texts = []
    for _, names in RULES:
        texts.append("Some words.\n" + " ".join(f"{first[n]}\nBetween two." for n in names) + "\nEnd")
        texts.append("\n".join(first[n].upper() for n in reversed(names)))
    got = scanned(spark, texts)
    for k, (licence, names) in enumerate(RULES):
        assert licence in got[2 * k]["licences"].split(",")
        assert got[2 * k]["n_known"] == len(names)
        if len(names) > 1:
            assert licence not in got[2 * k + 1]["licences"].split(",")


def test_odd_texts(spark):
    notice = "Released under the MIT License."
    texts = [None, "", "license " * 20_000, f"{notice}\n{notice}", f"x{notice}", f"...{notice}", "Released  under,\tthe MIT   License!", f"word {notice}", "İ LICENSE"]
    got = scanned(spark, texts)
    assert [got[i]["licences"] for i in range(len(texts))] == ["", "", "", "MIT", "", "MIT", "MIT", "", ""]
    assert got[3]["n_known"] == 2 and got[3]["sentence_ids"] == "1,1"
    repeated = spark.createDataFrame([(1, notice), (1, notice), (None, notice)], "doc_id long, text string")
    assert licences.scan(repeated).count() == 3 and licences.scan(repeated.limit(0)).count() == 0


def test_known_sentences_are_whole_and_distinct(spark):
    assert len(set(licences.KNOWN)) == len(licences.KNOWN)
    texts = [s for _, s in SENTENCES]
    got = scanned(spark, texts)
    assert [got[i]["sentence_ids"] for i in range(len(texts))] == [str(i + 1) for i in range(len(texts))]


def test_given_documents_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    docs = licences.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sorted(map(tuple, docs.collect())) == sorted(con.sql(licences.scan_sql()).fetchall())
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_wrapped_and_commented_sentences(spark):
    first = {}
    for name, sentence in SENTENCES:
        first.setdefault(name, sentence)
    marks = ["", "# ", " * ", "// ", "  ", "-- ", "rem ", "dnl "]
    texts, want = [], []
    for licence, names in RULES:
        for mark in marks:
            lines = []
            for n in names:
                lines += textwrap.wrap(first[n], 70 - len(mark), break_on_hyphens=False) + [""]
            texts.append("\r\n".join(["/*", *((mark + x).rstrip() for x in lines), " */"] if mark == " * " else [(mark + x).rstrip() for x in lines]))
            want.append((licence, [str(licences.NAMES.index(n) + 1) for n in names]))
    got = scanned(spark, texts)
    for i, (licence, ids) in enumerate(want):
        assert licence in got[i]["licences"].split(","), texts[i]
        assert got[i]["sentence_ids"].split(",") == ids


def test_line_breaks_inside_and_between_sentences(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright\n   notice, this list of conditions and the following disclaimer in the\n   documentation and/or other materials provided with the distribution.\n"
    head = "Licensed under the Apache License, Version 2.0\n(the \"License\"); you may not use this file except in\ncompliance with the License.\n"
    apart = "Licensed under\n\nthe MIT License"
    texts = [bsd, head, apart, "Copyright someone\nReleased under the MIT License\nAll else", "a\n" * 50_000 + "license"]
    got = scanned(spark, texts)
    assert [got[i]["licences"] for i in range(len(texts))] == ["BSD-2-Clause", "Apache-2.0", "", "MIT", ""]
