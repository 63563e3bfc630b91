import os

from tests.llm.helpers import empty, frame, with_clashes, words
from vitaloom.llm import licenses as L


def brute(text):
    known = [(L.canonical(t), i) for i, _, t in L.KNOWN]
    whole = [i for c, i in known if c == L.canonical(text or "")]
    notices = {i for line in L.canonical_lines(text or "") for c, i in known if c == line} | set(whole)
    return (min(whole) if whole else None, sorted(notices))


def test_scan(spark):
    mit = next(t for i, k, t in L.KNOWN if i == "MIT" and k == "license")
    texts = {
        1: mit, 2: mit.upper().replace(",", " ;").replace("License", "LICENCE"),
        3: mit.replace("Copyright (c) <year> <copyright holders>", "(c) 2020 Somebody\nCopyright 2021, Other"),
        4: mit + "\nmore", 5: None, 6: "", 7: "Licensed under the Apache License, Version 2.0.\n" + words(1, 300),
        8: "licenced under the APACHE Licence version 2 0", 9: "Copyright 2020 me", 10: "All rights reserved",
        11: "a\nAll rights reserved.\nb\nLicensed under CC BY-NC 4.0.\nAll Rights Reserved", 12: words(2, 20_000),
    }
    got = {r.doc_id: (r.license_id, r.notices) for r in L.scan(with_clashes(frame(spark, texts))).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}
    assert got[1] == got[2] == got[3] == ("MIT", ["MIT"]) and got[4][0] is None
    assert got[8] == ("Apache-2.0", ["Apache-2.0"])
    assert got[11] == (None, ["CC-BY-NC-4.0", "LicenseRef-All-Rights-Reserved"])


def test_repeated_rows_no_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "All rights reserved"), (1, "x"), (None, "All rights reserved")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.license_id) for r in L.scan(df).collect()), key=repr)
    assert got == sorted([(1, "LicenseRef-All-Rights-Reserved"), (1, None), (None, "LicenseRef-All-Rights-Reserved")], key=repr)
    assert L.scan(empty(spark)).count() == 0
    assert [r.notices for r in L.scan(df, L.known_digests(spark).limit(0)).collect()] == [[]] * 3


def test_whole_texts_of_common_licenses(spark):
    folder = "/usr/share/common-licenses/"
    files = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = {i: f for i, f in enumerate(files) if os.path.exists(folder + f)}
    texts = {i: open(folder + f, encoding="utf-8").read() for i, f in there.items()}
    bsd = next(t for i, _, t in L.KNOWN if i == "BSD-3-Clause")
    texts[100] = bsd.replace("<year>, <owner>", "2020, J. Smith Inc. All rights reserved.")
    got = {r.doc_id: r.license_id for r in L.scan(frame(spark, texts)).collect()}
    assert got == {i: files[f] for i, f in there.items()} | {100: "BSD-3-Clause"}
    assert {i for i, _, _ in L.KNOWN_DIGESTS} >= set(files.values())


def test_only_the_copyright_statement_goes():
    lines = L.canonical_lines
    assert lines("Copyright (c) 2020 X. All rights reserved.") == [["all", "rights", "reserved"]]
    assert lines("(c) 2021 Y. Licensed under the MIT License.") == [["licensed", "under", "the", "mit", "license"]]
    assert lines("(c) You must keep notices") == [["c", "you", "must", "keep", "notices"]]
    assert lines("copyright notice and this list") == [["copyright", "notice", "and", "this", "list"]]
    assert lines("Copyright 2020 J. Smith, K. Doe Inc.\n© 2019-2021 Z\n(C) COPYRIGHT 2020 Q") == []
    assert L.canonical("a\n(c) one") != L.canonical("a\n(c) two")
