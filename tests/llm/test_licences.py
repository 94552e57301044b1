from veritrace.llm import licences as q


def brute(docs):
    out = []
    for i, text in docs:
        text = text or ""
        for n, line in enumerate(text.split("\n")):
            g = set(q.bigrams_of(line))
            for k, (name, template) in enumerate(q.TEMPLATES):
                b = set(q.bigrams_of(template))
                if g and 2 * len(g & b) >= q.LEAST * (len(g) + len(b)):
                    out.append((i, n, name, k))
    return sorted(map(str, out))


def test_lines(spark):
    docs = [(1, "x\nLICENSED under the apache-license version 2.0!\ny"), (2, None), (3, ""), (None, "Released under MIT License"), (4, q.TEMPLATES[4][1].replace("Software", "program", 2)), (4, "CC BY-NC 4.0"), (5, "under the tree"), (6, "a " * 100_000 + "licensed"), (7, "by nc"), (1, "x\nLICENSED under the apache-license version 2.0!\ny")]
    df = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id long, text string, nth int, kind string")
    got = q.scan(df)
    assert sorted(str((r.doc_id, r.nth, r.licence, r.template)) for r in got.filter("kind = 'line'").collect()) == brute(docs)
    assert got.filter("kind = 'line' and doc_id = 1").count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert q.scan(df.limit(0)).count() == 0


def test_a_licence_over_several_lines(spark):
    text = "Title\n\n" + q.TEMPLATES[4][1].replace(". ", ".\n") + "\n\nmore words"
    got = q.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.kind, r.nth, r.licence) for r in got] == [("block", 1, "MIT"), ("document", 0, "MIT")]


def test_windows(spark):
    prose = " ".join(f"word{k}" for k in range(400))
    mit, apache, gpl = (q.TEMPLATES[k][1] for k in (4, 7, 11))
    spread = {1: mit.replace(": The above", ":\n\nThe above").replace(". THE", ".\n\nTHE"), 2: apache.replace(" Unless", "\n\n    Unless"), 3: gpl.replace(". This", ".\n\nThis").replace(". You", ".\n\nYou")}
    docs = [(k, f"{prose}\n\n{t}\n\n{prose}") for k, t in spread.items()]
    docs += [(4, "Copyright 2020 Jane Doe. Licensed under the Apache License, Version 2.0. All other rights are reserved by the holder."), (5, f"{mit} {prose} {mit} {mit}"), (6, f"{prose} under the {prose}"), (7, f"{prose}\nReleased under the MIT License.\n{prose}")]
    got = q.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    rows = sorted((r.doc_id, r.nth, r.template, round(r.dice, 6)) for r in got if r.kind == "window")
    n, m = 400, len(q.words_of(mit))
    assert [r for r in rows if r[2] in (4, 7, 11)] == [(1, n, 4, 1.0), (2, n, 7, 1.0), (3, n, 11, 1.0), (5, 0, 4, 1.0), (5, m + n, 4, 1.0), (5, 2 * m + n, 4, 1.0)]
    assert (4, 4, 5, 1.0) in rows and not [r for r in rows if r[0] in (6, 7)]
    assert [(r.kind, r.nth) for r in got if r.doc_id == 7] == [("line", 1)]


def test_probes_are_enough():
    found = set(q.probes(q.TEMPLATES))
    words, pattern = q.looked_for(sorted(found))
    for _, t in q.TEMPLATES:
        b = q.bigrams_of(t)
        need = -(-len(b) * q.LEAST // (2 - q.LEAST))
        assert len(b) - len(found & set(b)) < need
    assert words and pattern
