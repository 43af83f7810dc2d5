import pytest

from modelwatch.llm import license as C


@pytest.fixture(scope="module")
def model(spark, odd):
    return C.train(spark, odd)


def test_paragraphs(model):
    classify = C.classifier(model)
    assert model["held_out_accuracy"] > 0.95
    for family, texts in C.TEMPLATES.items():
        for text in texts:
            assert classify(text) == family and classify(text.upper()) == family, text
            assert classify(f"Some words before. {text} And some behind.") == family, text
    for text in ["", "plain words of a text", "the work of art in the age of software", "alpha4 beta7 gamma1"]:
        assert classify(text) == C.NONE
    assert classify("Licensed under the Foo Bar License, version 9.") == C.UNKNOWN


def test_documents(spark, odd, none):
    texts = ["Words.\nReleased under the MIT License.\n\nMore.\nLicensed under CC BY-NC 4.0.", None, "", " \n\t", "x\nReleased under the MIT License.\n" * 2]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, families string")
    got = {r.doc_id: tuple(r)[1:] for r in C.scan_documents(docs).collect()}
    assert got == {0: (4, 2, 0, "cc-by-nc,mit"), 1: (0, 0, 0, ""), 2: (0, 0, 0, ""), 3: (0, 0, 0, ""), 4: (4, 2, 0, "mit")}
    assert {(r.n_licences, r.n_unknown) for r in C.scan_documents(odd).collect()} == {(0, 0)}
    assert C.scan_documents(none).count() == 0


def test_wrapped_notices(model):
    scan = C.scanner(model)
    notices = {
        "gpl": ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation."],
        "bsd": ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following", "conditions are met:"],
        "isc": ["Permission to use, copy, modify, and/or distribute this software for any", "purpose with or without fee is hereby granted."],
        "mit": ["Permission is hereby granted, free of charge, to any person", "obtaining a copy of this software and", "associated documentation files."],
        "apache": ['Licensed under the Apache License, Version 2.0 (the "License");', "you may not use this file except in compliance with the License."],
    }
    for family, lines in notices.items():
        for mark in ("", " * ", "# "):
            notice = "\n".join(mark + line for line in lines)
            assert scan(notice) == (1, [family], 0), notice
            assert scan(f"alpha4 beta7\n{notice}\ngamma1 delta2 words\n\nplain words of a text") == (4, [family], 0), notice
        narrow = "\n".join(" ".join(lines).split())
        assert scan(narrow)[1:] == ([family], 0), family
        apart = "\n\n".join(lines)
        assert scan(apart)[0] == len(lines)
    n, found, unknown = scan("Licensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0.\nReleased under the MIT License.")
    assert (n, sorted(found), unknown) == (3, ["cc-by", "cc-by-sa", "mit"], 0)
    assert scan("Released under the MIT License.\nThis project is licensed under the terms of the MIT license.") == (2, ["mit", "mit"], 0)
