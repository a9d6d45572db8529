"""Licence texts among many other licence words."""

from dyadflow.llm.licenses import TEMPLATES, scan_licenses


def test_notice_among_rarer_words(spark):
    common = [(i, "Licensed under CC BY-NC 4.0.") for i in range(40)]
    rare = "foundation mozilla gnu restriction merge redistribution merchant obtaining documentation associated permitted conditions binary charge"
    every = " and then ".join(text for _, _, text in TEMPLATES)
    rows = [*common, (100, f"{rare} words and Licensed under CC BY-NC 4.0."), (101, every), (102, f"{rare} cc by words nc")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].labels == got[100].labels == "cc-by-nc" and got[100].score > 0.9
    assert got[101].labels == ",".join(sorted({label for label, _, _ in TEMPLATES})) and got[102].labels == ""


def test_key_phrase_with_other_words_between(spark):
    rest = " to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    rows = [(1, "Permission never hereby granted, free never charge," + rest), (2, "x Permission is hereby granted, free of charge," + rest), (3, "Redistribution or use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"), (4, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met")]
    got = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "mit", 3: "", 4: "bsd"}
