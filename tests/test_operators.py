"""Chunk analytics: folds against small twins, properties, fixtures that the test tables can't supply."""

import math
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing, text as tx
from tessera.operators import boundary, chunkers, evaluate, graph, profile, refine, retrieval, reward, signals, tune, windows
from tessera.sources import formats, readers, sinks

LEGAL = "CHAPITRE I\n\nArticle 1\nLe contrat est formé. Il lie les parties.\n\nArticle 2 - Objet\n1) premier point de la liste\n2) second point de la liste\n\nArticle 3\n" + "Une phrase assez longue pour remplir. " * 60
CODE = "import os\n\ndef a(x):\n    return x\n\nclass B:\n    pass\n" * 20
MARKDOWN = "# One\n\nText of one.\n\n## Two\n\n- item\n- item\n\n## Three\n\nMore text here. And more.\n"
TABLE = "| a | b |\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |\n"


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join(("" if i % 9 else "The ") + "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) + ("." if i % 9 == 8 else "") for i in range(n))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_types_and_structures(spark):
    got = frame(spark, [LEGAL, CODE, MARKDOWN, TABLE, words(50), "", "a\n\nb\n\nc"]).select("doc_id", profile.doc_type(F.col("text")).alias("t")).withColumn("x", F.lit(1))
    kinds = [r.t for r in got.orderBy("doc_id").collect()]
    assert kinds == ["prose", "code", "mixed", "table", "prose", "prose", "prose"]
    texts = [LEGAL, CODE, MARKDOWN, TABLE, words(50), "", "a\n\nb\n\nc"]
    native = frame(spark, texts).select("doc_id", profile.structure_type(F.col("text"), profile.doc_type(F.col("text"))).alias("s")).orderBy("doc_id").collect()
    assert [r.s for r in native] == ["legal_article", "code", "sectioned", "table", "plain", "plain", "paragraph"]
    assert [chunkers.structure_of(t, k) for t, k in zip(texts, kinds)] == [r.s for r in native]


def test_profiles_of_odd_texts(spark):
    rows = profile.profiles(frame(spark, [LEGAL, CODE, MARKDOWN, TABLE, words(3000), "", "  \n", "x", "!!!!!", None])).collect()
    assert len(rows) == 10
    for r in rows:
        assert all(0 <= r[m] <= 1 for m in (*profile.METRICS, "overall", "weighted_overall")) and r.sug_n_min < r.sug_n_max
    assert {r.doc_id: r.domain for r in rows}[0] == "legal"


@pytest.mark.parametrize("strategy", chunkers.STRATEGIES)
@pytest.mark.parametrize("text", [LEGAL, CODE, MARKDOWN, TABLE, words(2500), words(40), "", " \n ", "one", "é\u2028è \r\n ü."])
def test_chunks_keep_order_and_words(strategy, text):
    kind = "code" if text is CODE else "table" if text is TABLE else "prose"
    found = chunkers.chunk_text(text, strategy, kind, 20, 100)
    assert [c.start for c in found] == sorted(c.start for c in found)
    for c in found:
        assert c.text == c.text.strip() and c.text and 0 <= c.start <= c.end <= len(text)
    if strategy in ("paragraph_pack", "sentence_clustering", "semantic_boundaries") and found:
        got, want = [w for c in found for w in c.text.split()], text.split()
        assert [w.strip(".!?;,") for w in got if w.strip(".!?;,")] == [w.strip(".!?;,") for w in want if w.strip(".!?;,")]


def test_packing_bounds():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.choice((1, 5, 30, 80, 100, 200)) for _ in range(rng.randint(0, 12))]
        runs = list(chunkers.fill(sizes, 100, [False] * len(sizes)))
        assert [i for a, b in runs for i in range(a, b)] == list(range(len(sizes)))
        assert all(sum(sizes[a:b]) <= 100 or b == a + 1 for a, b in runs)
        assert list(chunkers.cut_runs(sizes, 10**6, [])) == ([(0, len(sizes))] if sizes else [])
        small = chunkers.settle(sizes, 50, 100)
        assert [i for a, b in small for i in range(a, b)] == list(range(len(sizes)))
        assert all(sum(sizes[a:b]) <= 125 or b == a + 1 for a, b in small)
    assert list(chunkers.fill([90, 40], 100, [False, True])) == [(0, 2)] and list(chunkers.fill([90, 40], 80, [False, True])) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("strategy", chunkers.STRATEGIES)
def test_offsets_are_those_of_the_words(strategy):
    long = "Article 1\n" + words(700, 4) + "\n\nArticle 2\n" + "\n".join(f"{i}) " + words(60, i) for i in range(1, 9)) + "\n\nArticle 3 bis\n" + words(30, 5)
    found = chunkers.chunk_text(long, strategy, "prose", 40, 150)
    assert found
    for c in found:
        assert c.text.split()[0] in long[c.start : c.end].split()[0] and long[c.start : c.end].split()[-1].startswith(c.text.split()[-1][:3])


def test_legal_strategies_need_legal_structure(spark):
    docs = spark.createDataFrame([(1, LEGAL, "prose"), (2, words(900), "prose"), (3, None, "prose")], "doc_id bigint, text string, type string")
    got = {(r.doc_id, r.strategy) for r in chunkers.chunk(docs).collect()}
    assert (1, "legal_articles") in got and (2, "legal_articles") not in got and not any(i == 3 for i, _ in got)


def test_sliding_windows_cover_every_token(spark):
    for size, overlap in ((10, 0), (10, 3), (7, 7)):
        docs = frame(spark, [words(n) for n in (0, 1, 9, 10, 11, 25)])
        for i, n in enumerate((0, 1, 9, 10, 11, 25)):
            rows = windows.sliding_window(docs, size, overlap).filter(F.col("doc_id") == i).orderBy("idx").collect()
            step = max(1, size - overlap)
            covered = {r.idx * step + k for r in rows for k in range(r.n_words)}
            assert covered == set(range(len(words(n).split())))
            assert not rows or rows[-1].idx * step + rows[-1].n_words == len(words(n).split())


def test_signals_native_and_fold_agree(spark):
    texts = [words(30, s) for s in range(6)] + ["", "Article 2 - x. " + words(20, 9)]
    chunks = spark.createDataFrame([(1, i, t, len(t.split())) for i, t in enumerate(texts)], "doc_id bigint, idx int, text string, n_words int")
    native = {r.idx: r for r in signals.features(chunks).collect()}
    assert sorted(native) == list(range(7))
    for i, (a, b) in enumerate(zip(texts, texts[1:])):
        want = refine.boundary_features(a, b)
        for k, v in want.items():
            assert native[i][k] == pytest.approx(v, abs=1e-9), (i, k)
            assert 0 <= v <= 1
    assert max(r.jsd for r in native.values()) <= math.log(2) + 1e-9


def test_scores_native_and_fold_agree(spark):
    texts = [words(30, s) for s in range(5)]
    chunks = spark.createDataFrame([(1, i, t, 30) for i, t in enumerate(texts)], "doc_id bigint, idx int, text string, n_words int")
    for r in boundary.scores(chunks).collect():
        assert r.boundary_score == pytest.approx(refine.boundary_score(texts[r.idx - 1], texts[r.idx], r.multiscale), abs=1e-9)


def test_refinement(spark):
    same = words(40, 1)
    rows = refine.refine_chunks([same, same, words(40, 2), "Article 5 - y\n" + words(30, 3), words(40, 4)], low=40, high=80)
    assert rows[-1]["boundary_type"] == "end" and sum(r["n_merged"] + 1 for r in rows) == 5
    assert any(r["boundary_type"] == "hard" for r in rows)
    assert refine.refine_chunks([]) == [] and refine.refine_chunks(["x"])[0]["boundary_type"] == "end"
    merged = refine.merge_similar([same, same, words(40, 2)], [1.0, 1.0, 0.0], tau=0.75)
    assert [r["n_merged"] for r in merged] == [1, 0]
    cell = refine.Recurrent()
    score = cell.step({"jsd": 0.2, "hellinger": 0.15, "entropy_rate": 0.3, "pmi_drop": 0.25, "depth_change": 0.0, "drift": 0.18})
    assert 0 < score < 1 and cell.c.shape == (14,)
    df = spark.createDataFrame([(i, "s", k, t) for i in range(3) for k, t in enumerate([same, same, words(30, 5)])], "doc_id bigint, strategy string, idx int, text string")
    a, b = (sorted(refine.refine(df.repartition(n)).collect()) for n in (1, 8))
    assert a == b


def test_coherence_of_numbered_paragraphs(spark):
    text = "1) alpha beta gamma delta\n2) alpha beta gamma omega\n3) one two three four"
    chunks = spark.createDataFrame([(1, 0, text, 15), (1, 1, "short", 1)], "doc_id bigint, idx int, text string, n_words int")
    got = {r.idx: r.icc for r in boundary.coherence(chunks).collect()}
    assert got[1] == 0.5 and got[0] == pytest.approx((3 / 7 + 0) / 2)


def test_evaluation_against_twins(spark):
    rows = [(1, "a", 0, "First chunk here.", 0, 20), (1, "a", 1, "second one", 15, 40), (1, "a", 2, "", 40, 40)]
    chunks = spark.createDataFrame(rows, "doc_id bigint, strategy string, idx int, text string, start int, end int")
    docs = spark.createDataFrame([(1, "x" * 50)], "doc_id bigint, text string")
    s = evaluate.spans(chunks, docs).first()
    assert s.coverage == pytest.approx(45 / 50) and s.non_redundancy == pytest.approx(1 - 5 / 45)
    assert evaluate.boundary_quality(chunks).first().boundary_quality == pytest.approx((1.0 + 0.45 + 0.5) / 3)


def test_bm25_against_a_plain_index(spark):
    texts = [words(40, s) for s in range(7)]
    chunks = spark.createDataFrame([(1, i, t, 40) for i, t in enumerate(texts)], "doc_id bigint, idx int, text string, n_words int")
    got = {(r.q, r.d): r.score for r in retrieval.bm25_scores(chunks).collect()}
    tok = lambda t: [w for w in refine.tokens(t) if len(w) > 1]
    asks = [r.q for r in chunks.orderBy("idx").select(retrieval.first_sentence(F.col("text")).alias("q")).collect()]
    for q in range(7):
        others = {d: tok(texts[d]) for d in range(7) if d != q}
        mean = sum(map(len, others.values())) / 6
        for d, toks in others.items():
            want = 0.0
            for t in tok(asks[q]):
                df, tf = sum(t in x for x in others.values()), toks.count(t)
                if tf:
                    want += max(0.0, math.log((6 - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / mean))
            assert got.get((q, d), 0.0) == pytest.approx(want, abs=1e-8)
    m = retrieval.ranking_metrics(chunks, retrieval.bm25_scores(chunks)).first()
    assert m.n_queries == 7 and all(0 <= m[k] <= 1 for k in ("mrr", "ndcg", "precision", "recall"))


def test_entities_relations_edges(spark):
    texts = ["We met Jane Smith. She owns Big Company today.", "Then the same Jane Smith left and uses Blue Thing, a Big Company product.", "Nothing here."]
    chunks = spark.createDataFrame([(1, i, t, 9) for i, t in enumerate(texts)], "doc_id bigint, idx int, text string, n_words int")
    ents = graph.entities(chunks)
    assert {(r.idx, r.canonical) for r in ents.collect()} >= {(0, "jane smith"), (0, "big company"), (1, "blue thing")}
    edge = graph.edges(ents, graph.relations(chunks, ents)).collect()
    assert [(r.source, r.target) for r in edge] == [(0, 1)] and "shared_entity" in edge[0].types
    store = graph.cooccurrence(ents)
    twice = graph.upsert(store, store)
    assert {(r.a, r.b): r.cnt for r in twice.collect()} == {(r.a, r.b): 2 * r.cnt for r in store.collect()}
    warm = graph.edges(ents, None, store).first()
    assert warm.types == ["kg_prior", "shared_entity"]


def test_genes(spark):
    rng = random.Random(1)
    rows = [[rng.random() for _ in range(7)] for _ in range(40)] + [[0.0] * 7, [1.0] * 7]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, genes array<double>")
    for r in df.select("i", *[c.alias(n) for n, c in tune.decode(F.col("genes")).items()]).collect():
        want = tune.decoded(rows[r.i])
        assert {k: pytest.approx(v) for k, v in want.items()} == {k: r[k] for k in want}
        assert want["n_min"] <= want["n_max"] - 50 or want["n_min"] == 30
    s = tune.Search(6, warm={n: lo for n, lo, *_ in tune.GENES})
    best = s.population[3].copy()
    s.evolve([0, 1, 2, 9, 3, 4])
    assert (s.population[0] == best).all() and len(s.population) == 6


def test_repeated_lines_and_page_numbers(spark):
    pages = spark.createDataFrame([(1, p, f"Header\nbody {p} line\nmore {p}\nx{p}\ny{p}\nz{p}\n- {p} -\n{p} of 9\nFooter") for p in range(4)], "doc_id bigint, page bigint, text string")
    assert {r.line for r in readers.repeated_lines(pages).collect()} == {"Header", "Footer"}
    out = readers.strip_repeated_lines(pages).select(readers.without_page_numbers(F.col("text")).alias("t")).collect()
    assert all("Header" not in r.t and " of 9" not in r.t and "- " not in r.t and "body" in r.t for r in out)


def test_files_and_config(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo", "utf-8")
    (tmp_path / "b.md").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.txt").write_text("  \n")
    got = {r.filename: (r.text, r.extension) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("héllo", "txt"), "b.md": ("café", "md")}
    c = readers.Config().updated(n_min=5, tau_jsd_low=0.6)
    assert c.n_min == 20 and c.tau_jsd_high > c.tau_jsd_low
    assert readers.Config().updated(n_max="x", entropy_metric="HELLINGER", chunking_strategy="no such") == readers.Config(entropy_metric="hellinger")
    (tmp_path / "c.yaml").write_text("pipeline:\n  n_min: 55\n  tau_sem: 7\n  unheard_of: 1\n")
    (tmp_path / "bad.yaml").write_text("pipeline: [")
    assert readers.Config.from_yaml(spark, str(tmp_path / "c.yaml")) == readers.Config(n_min=55, tau_sem=0.99)
    assert readers.Config.from_yaml(spark, str(tmp_path / "bad.yaml")) == readers.Config.from_yaml(spark, str(tmp_path / "none.yaml")) == readers.Config()
    with pytest.raises(ValueError):
        readers.Config().updated(unknown=1)


def pdf_file(pages, flate, packed):
    """A PDF of the content streams, with fonts F1 (simple, with differences) and F2 (composite, with a map); packed: objects in a stream."""

    def stream(x, head=b""):
        x = zlib.compress(x) if flate else x
        return b"<< %s /Length %d %s>>\nstream\n%s\nendstream" % (head, len(x), b"/Filter /FlateDecode " if flate else b"", x)

    unicode = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0015> <0041> <0020> <0021> [<00e9> <D83DDE00>] endbfrange"
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages)))
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [%s] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % kids,
        3: b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /fi /eacute] >> >>",
        4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>",
        5: stream(unicode),
    }
    for k, page in enumerate(pages):
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        objects[11 + 2 * k] = stream(page)
    if packed:
        inner = {k: v for k, v in objects.items() if b"stream" not in v}
        places = [sum(len(v) + 1 for v in list(inner.values())[:i]) for i in range(len(inner))]
        head = b"".join(b"%d %d " % x for x in zip(inner, places))
        objects = {k: v for k, v in objects.items() if k not in inner}
        objects[99] = stream(head + b" ".join(inner.values()), b"/Type /ObjStm /N %d /First %d" % (len(inner), len(head)))
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


PDF_PAGES = [
    b"BT /F1 12 Tf 72 700 Td (Hello \\(world\\)) Tj 0 -14 Td [(spl) -20 (it) -300 (words \\001\\002)] TJ T* (octal \\351) Tj ET",
    b"BT /F2 10 Tf 1 0 0 1 72 700 Tm <001000110003001200200021> Tj ET\n% note\nBT /F1 9 Tf 0 0 Td (two) Tj ET",
]


def test_pdf_text():
    for flate in (False, True):
        for packed in (False, True):
            assert formats.pdf_pages(pdf_file(PDF_PAGES, flate, packed)) == ["Hello (world)\nsplit words fié\noctal é", "AB Cé😀\ntwo"]
    whole = pdf_file(PDF_PAGES, True, False)
    for k in range(0, len(whole), 7):  # damaged files give what can be read
        assert all(isinstance(x, str) for x in formats.pdf_pages(whole[:k]) + formats.pdf_pages(whole[:k] + b"\xff((<<[" + whole[k + 9 :]))
    assert formats.pdf_pages(b"") == formats.pdf_pages(b"/Encrypt 4 0 R " + whole) == []


def test_files_are_read_by_their_extension(spark, tmp_path):
    lines = lambda *x: b"BT /F1 9 Tf " + b" ".join(b"0 -9 Td (%s) Tj" % y for y in x) + b" ET"
    (tmp_path / "a.PDF").write_bytes(pdf_file([lines(b"Running head", b"body %d" % k, b"- %d -" % k) for k in range(3)], True, True))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 nothing")
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "<w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tbl><w:p><w:r><w:t>Three</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "c.doc").write_text("not a zip file")
    (tmp_path / "noext").write_bytes("\ufeffmärked".encode("utf-8"))
    (tmp_path / "d.txt").write_bytes("märked".encode("utf-16"))
    found = readers.read_files(spark, str(tmp_path))
    assert {r.filename: (r.text, r.extension) for r in found.collect()} == {
        "a.PDF": ("body 0\n\nbody 1\n\nbody 2", "pdf"), "b.docx": ("One\ttwo\n\nThree", "docx"), "c.doc": ("not a zip file", "doc"), "noext": ("märked", "txt"), "d.txt": ("märked", "txt"),
    }
    other = readers.read_files(spark, str(tmp_path), pdf=lambda data: ["x", "y"], docx=lambda data: "z")
    assert {r.filename: r.text for r in other.filter("extension <> 'txt'").collect()} == {"a.PDF": "x\n\ny", "broken.pdf": "x\n\ny", "b.docx": "z", "c.doc": "z"}


def test_running_lines_agree_with_the_table(spark):
    rng = random.Random(2)
    docs = [[" \n".join(rng.choice(["head", "foot", "a b", "c", "", "7", "long " * 13]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 5))] for _ in range(40)]
    pages = spark.createDataFrame([(i, k, p) for i, d in enumerate(docs) for k, p in enumerate(d)], "doc_id bigint, page int, text string")
    clean = {(r.doc_id, r.page): r.text for r in readers.strip_repeated_lines(pages).select("doc_id", "page", readers.without_page_numbers(F.col("text")).alias("text")).collect()}
    for i, d in enumerate(docs):
        want = "\n".join(clean[i, k] for k in range(len(d)))
        assert [x for x in formats.join_pages(d, readers.PAGE_NUMBER).split("\n") if x.strip()] == [x for x in want.split("\n") if x.strip()]


def test_sinks(spark):
    chunks = spark.createDataFrame([(1, 1, "b\nc", 2, 0.6), (1, 0, "a", 1, 0.9)], "doc_id bigint, idx int, text string, n_words int, score double")
    about = spark.createDataFrame([(1, "prose", "legal")], "doc_id bigint, type string, domain string")
    named = chunks.withColumn("entities", F.when(F.col("idx") == 0, F.array(F.lit("Jane"), F.lit("Acme")))).withColumn("chunk_score", F.col("score"))
    assert sinks.markdown(named, about).first().markdown == (
        "# Chunking results\n\n- Document type: prose\n- Domain: legal\n- Chunks: 2\n- Mean score: 0.75\n\n"
        "---\n<!-- chunk_index: 0 | tokens: 1 | score: 0.9 | entities: Jane, Acme -->\na\n\n---\n<!-- chunk_index: 1 | tokens: 2 | score: 0.6 | entities:  -->\nb\nc\n"
    )
    rows = sinks.csv_rows(named).orderBy("index").collect()
    assert [(r.text_preview, r.entities, r.boundary_type) for r in rows] == [("a", "Jane, Acme", None), ("b c", "", None)]
    assert rows[0].asDict().keys() == {"doc_id", "index", "token_count", "chunk_score", "jsd_score", "boundary_score", "boundary_type", "entities", "text_preview"}
    assert sinks.explore(chunks.withColumn("boundary_type", F.lit("soft")), "b", boundary_type="hard").count() == 0
    assert [r.idx for r in sinks.explore(chunks, "B", "medium").collect()] == [1]
    assert sinks.json_documents(chunks).first().json.index('"a"') < sinks.json_documents(chunks).first().json.index('"b')


def test_streaming_equals_batch(spark, tmp_path):
    from tessera.streaming import incremental

    docs = frame(spark, [words(250, s) for s in range(6)])
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.run(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = signals.distances(windows.sliding_window(docs))
    assert sorted(map(tuple, got.select("doc_id", "idx").collect())) == sorted(map(tuple, want.select("doc_id", "idx").collect()))


def test_content_tokens_fall_back(spark):
    r = frame(spark, ["the of", "cat the"]).select(tx.content_tokens(F.col("text"), tx.STOP_PROFILE).alias("t")).collect()
    assert [x.t for x in r] == [["the", "of"], ["cat"]]


def test_entity_queries_count_every_entity(spark, tmp_path):
    from collections import Counter
    from itertools import combinations, permutations

    from tessera.plans import catalog

    body = "we met Ada Lovelace and Rome there. So Ada Lovelace has Rome now, says Charles Babbage. "
    texts = [body * 20, words(150, 3), "the Rome of Paris " * 60]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    run = {n: catalog.queries()[n](spark, str(tmp_path)).collect() for n in ("entities", "relations", "entity_cooccurrence", "entity_edges")}
    of, related, pairs, weights = {}, {}, Counter(), Counter()
    for r in run["entities"]:
        of.setdefault((r.doc_id, r.idx), set()).add(r.canonical)
    for r in run["relations"]:
        related.setdefault((r.doc_id, r.idx), set()).add((r.subject.lower(), r.object.lower()))
    for found in of.values():
        pairs.update(permutations(found, 2))
    for kind in (of, related):
        for a, b in combinations(sorted(kind), 2):
            if a[0] == b[0] and kind[a] & kind[b]:
                weights[a[0], a[1], b[1]] += len(kind[a] & kind[b])
    assert {(r.a, r.b): r.cnt for r in run["entity_cooccurrence"]} == pairs and any(len(a) < 14 for a, _ in pairs)
    assert {(r.doc_id, r.source, r.target): r.weight for r in run["entity_edges"]} == weights
    assert any("relation_bridge" in r.types for r in run["entity_edges"])


def test_structure_integrity_against_a_plain_count(spark):
    rng, rows, docs = random.Random(4), [], []
    for i in range(6):
        parts = [f"Article {k + 1}\n" + words(rng.choice((30, 200, 900)), 10 * i + k) for k in range(rng.randint(1, 6))]
        text = words(20, 99 + i) + "\n\n" + "\n\n".join(parts) if i else "no heads here. " * 9
        docs.append((i, text))
        rows += [(i, s, k, "T.", sum(map(len, text[:a]))) for s in ("a", "b") for k, a in enumerate(sorted(rng.sample(range(len(text)), 6)))]
    chunks = spark.createDataFrame([(i, s, k, t, a, a + 5) for i, s, k, t, a in rows], "doc_id bigint, strategy string, idx int, text string, start int, end int")
    got = {(r.doc_id, r.strategy): r.structure_integrity for r in evaluate.structure_integrity(chunks, spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    import re

    for i, text in docs:
        heads = [m.start() for m in re.finditer(evaluate.ANCHOR, text, re.M | re.I)]
        for s in "ab":
            starts = [r[4] for r in rows if r[:2] == (i, s)]
            if not heads:
                assert got[i, s] == pytest.approx(1.0)  # boundary quality
                continue
            whole = []
            for a, b in zip(heads, [*heads[1:], len(text)]):
                e = max(1, round(len(text[a:b].split()) / 420))
                whole.append(1 - min(1, max(0, sum(a + 80 < x < b - 80 for x in starts) - e) / e))
            near = sum(any(abs(x - a) <= 80 for x in starts) for a in heads) / len(heads)
            assert got[i, s] == pytest.approx(0.62 * near + 0.38 * sum(whole) / len(whole))


def test_probes_and_reward(spark):
    text = LEGAL + "\n\n# A heading here\n\n2.1 numbered part of it\n\nThe first sentence of this paragraph has many words. And more."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "short one")], "doc_id bigint, text string")
    found = [r.probe for r in reward.probes(docs).orderBy("pos").collect()]
    assert 1 <= len(found) <= 8 and all(r.doc_id == 1 for r in reward.probes(docs).collect())
    chunks = spark.createDataFrame([(1, "s", 0, found[0], "hard", 0.5, 0.4), (1, "s", 1, "zzz qqq.", "soft", None, None), (1, "s", 2, "the end", "end", 0.1, 0.9), (3, "s", 0, "x", "end", 0.2, None)], "doc_id bigint, strategy string, idx int, text string, boundary_type string, icc double, pmi_drop double")
    got = {r.doc_id: r for r in reward.reward(chunks, reward.probes(docs), 1, 20).collect()}
    assert got[3].coverage == 0.5 and got[3].quality == pytest.approx(0.55 * 0.5 + 0.45 * 0.2)
    assert got[1].structural == pytest.approx(0.5 * 0.5 + 0.5 * 0.45) and 0 < got[1].coverage <= 1
    assert got[1].efficiency == pytest.approx(1 - (3 - 2) / 3)
    capped = reward.reward(chunks, reward.probes(docs), 1000, 2000).filter("doc_id = 1").first()
    assert capped.total <= 0.5


def test_trials_read_every_parameter(spark):
    docs = spark.createDataFrame([(i, words(1500, i), "prose") for i in range(3)] + [(9, None, "prose")], "doc_id bigint, text string, type string")
    base = {n: (lo + hi) / 2 for n, lo, hi, _ in tune.GENES} | {"n_min": 40, "n_max": 160}
    same = [("paragraph_pack", base), ("paragraph_pack", base | {"tau_sem": 0.05}), ("paragraph_pack", base | {"tau_percentile_low": 45.0, "tau_percentile_high": 95.0}), ("paragraph_pack", base | {"n_max": 300})]
    rows = tune.run_trials(docs, same).collect()
    texts = {k: [(r.doc_id, r.idx, r.text, r.boundary_type) for r in rows if r.strategy == str(k)] for k in range(4)}
    assert all(texts[0] != texts[k] for k in (1, 2, 3))
    low, high = ({r.boundary_type for r in tune.run_trials(docs, [("paragraph_pack", base | {"tau_jsd_low": a, "tau_jsd_high": b})], "fixed").collect()} for a, b in ((0.05, 0.2), (0.05, 0.99)))
    assert low == {"hard", "end"} and high == {"soft", "end"}
    trials = tune.search(docs, ("paragraph_pack", "legal_articles"), size=3, generations=2)
    assert trials.count() == 12 and {r.fitness for r in trials.filter("strategy = 'legal_articles'").collect()} == {-1.0}
    best = tune.winner(trials).collect()
    assert len(best) == 1 and best[0].fitness == max(r.fitness for r in trials.collect()) and tune.winner(trials, ("strategy",)).count() == 2


def test_twins_of_the_merge(spark):
    texts = ["1) Alpha beta gamma delta.\n2) Alpha beta other words here.", "Some text of four words. More text of four words.", words(60, 3), words(60, 4), "x"]
    chunks = spark.createDataFrame([(1, i, t, 30) for i, t in enumerate(texts)], "doc_id bigint, idx int, text string, n_words int")
    native = {r.idx: r.multiscale for r in boundary.multiscale(chunks).collect()}
    assert [native.get(i, 0.0) for i in range(5)] == pytest.approx(refine.multiscale(texts))
    assert {r.idx: pytest.approx(r.icc) for r in boundary.coherence(chunks).collect()} == dict(enumerate(map(refine.coherence, texts)))
    code = chunks.select(boundary.structural_code(F.lit("a {"), F.lit("# x\n}")).alias("s")).first().s
    assert refine.structural("a {", "# x\n}", "code") == pytest.approx(code)
    merged = refine.merge_similar([texts[1]] * 3 + [texts[2]], [1.0] * 3 + [0.0], 0.6)
    assert [m["n_merged"] for m in merged] == [2, 0] and merged[0]["icc"] == refine.coherence(texts[1])


def test_winners_by_bias(spark):
    rows = [(1, "semantic_boundaries", 2, 0.50), (1, "sliding_window", 2, 0.60), (2, "semantic_boundaries", 2, 0.50), (2, "structure", 2, 0.50), (3, "legal_articles", 1, 0.5), (3, "hybrid_legal_semantic", 1, 0.47)]
    q = spark.createDataFrame(rows, "doc_id bigint, strategy string, n_chunks int, quality double")
    kinds = spark.createDataFrame([(1, "prose"), (2, "code"), (3, "prose")], "doc_id bigint, type string")
    pick = lambda forced=None: {r.doc_id: r.strategy for r in evaluate.winners(q, kinds, chunkers.PREFERENCE, chunkers.STRATEGIES, forced).collect()}
    assert pick() == {1: "semantic_boundaries", 2: "structure", 3: "hybrid_legal_semantic"}
    assert pick("sliding_window")[1] == "sliding_window"


def test_reports(spark):
    from tessera.operators import report

    rows = [(1, "s", 0, "a  b\nc", "hard", 0.7, 0.2, 1), (1, "s", 1, "d", None, None, None, 0), (1, "s", 2, "e", "end", 0.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, strategy string, idx int, text string, boundary_type string, signal double, jsd double, n_merged int")
    assert [(r.preview, r.boundary_type, r.signal) for r in report.summary(df).orderBy("idx").collect()] == [("a b c", "hard", 0.7), ("d", "unknown", 0.0), ("e", "end", 0.0)]
    assert report.signal_series(df).first().series == [0.7, 0.0, 0.0]
    s = report.stage_stats(df, df.unionByName(df.limit(1))).first()
    assert (s.initial_count, s.final_count, s.merged_count, s.hard_count, s.end_count) == (4, 3, 1, 1, 1) and s.merge_ratio == pytest.approx(1 / 3) and s.mean_signal == pytest.approx(0.7)
    levels = {(r.metric): (r.level, r.reason) for r in report.metric_levels(spark.createDataFrame([(1, 0.7, 0.4, 0.1, 1.0, 0.0)], "doc_id bigint, RC double, ICC double, DCC double, BI double, SC double")).collect()}
    assert levels["RC"][0] == "strong" and levels["ICC"][0] == "usable" and levels["SC"] == ("weak", report.REASONS["SC"]["weak"])


def _three(texts):
    return [[float(len(t)), 1.0, 2.0] for t in texts]


def test_models_are_plugged_in(spark, tmp_path):
    from tessera.operators import models

    df = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "alpha beta"), (2, 0, "")], "doc_id bigint, idx int, input string")
    got = {(r.doc_id, r.idx): r for r in models.embeddings(df, {"e5-large-v2": lambda: _three, "none": lambda: 1 / 0}).collect()}
    assert got[1, 0].vector == pytest.approx(models.project([10.0, 1.0, 2.0]).tolist()) and len(got[2, 0].vector) == 256
    bags = {(r.doc_id, r.idx): r for r in models.embeddings(df, {"none": lambda: 1 / 0}).collect()}
    assert bags[1, 0].models == ["bow_fallback"] and sum(x * x for x in bags[1, 0].vector) == pytest.approx(1.0)
    assert (models.project([1.0] * 256) == 1.0).all()
    path = str(tmp_path / "cache")
    for _ in range(2):
        assert [r.vector for r in models.cached(df, "m", lambda: _three, path).orderBy("doc_id", "idx").collect()] == _three(["alpha beta", "alpha beta", ""])
        assert spark.read.parquet(path).count() == 2
    pairs = spark.createDataFrame([("a b c d e", "f g h i j"), ("x", "y")], "text string, text_b string")
    ppl = models.perplexities(pairs, lambda: lambda ts: [float(len(t)) for t in ts]).withColumn("ok", boundary.allowed_merge(F.col("ppl_a"), F.col("ppl_b"), F.col("ppl_both"))).collect()
    assert (ppl[0].ppl_a, ppl[0].ppl_both, ppl[0].ok) == (9.0, 20.0, False) and ppl[1].ppl_a is None and ppl[1].ok
    crossed = models.cross_scores(pairs, lambda: lambda ps: [0.5 if a < "b" else None for a, _ in ps])
    assert [r.s for r in crossed.select(boundary.semantic_score(F.lit(0.25), None, F.col("cross_score")).alias("s")).collect()] == [0.75, 0.25]
    ents = models.entities(spark.createDataFrame([(1, 0, "Acme Corp. met Jane")], "doc_id bigint, idx int, text string"), lambda: lambda ts: [[("Acme Corp.", "ORG"), ("Jane", "PERSON")] for _ in ts]).collect()
    assert [(r.pos, r.entity_id, r.parent_id) for r in ents] == [(1, "ORG::acme corp", "ORG::corp"), (2, "PERSON::jane", "PERSON::jane")]


def test_store_of_entities(spark, tmp_path):
    path = str(tmp_path / "kg")
    assert [t.count() for t in graph.load_store(spark, path)] == [0, 0]
    ents = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "a")], "doc_id bigint, idx int, canonical string")
    for run in range(2):
        pairs, index = graph.load_store(spark, path)
        graph.save_store(path, graph.upsert(pairs, graph.cooccurrence(ents)), index.unionByName(graph.chunk_index(ents, f"r{run}", run)), most=3)
    pairs, index = graph.load_store(spark, path)
    assert {(r.a, r.b): r.cnt for r in pairs.collect()} == {("a", "b"): 2, ("b", "a"): 2}
    assert sorted((r.entity, r.chunk) for r in index.collect()) == [("a", "r0::1::C1"), ("a", "r1::1::C0"), ("a", "r1::1::C1"), ("b", "r0::1::C0"), ("b", "r1::1::C0")]
    assert graph.store_versions(spark, path) == [0, 1]


def test_code_is_scored_as_code(spark):
    texts = ["def f(x):\n    return {x: 1}", "# heading\ndef g(x):\n    return {x: 2}", "if (a < b) { c(); }"]
    chunks = spark.createDataFrame([(1, i, t, 30, "code") for i, t in enumerate(texts)], "doc_id bigint, idx int, text string, n_words int, type string")
    for r in boundary.scores(chunks).collect():
        assert r.boundary_score == pytest.approx(refine.boundary_score(texts[r.idx - 1], texts[r.idx], r.multiscale, "code"), abs=1e-9)


def test_bootstrap_against_plain_draws(spark):
    import hashlib

    import numpy as np

    texts = [words(120, s) for s in range(3)] + ["One. Two.", "", None]
    got = {r.doc_id: r for r in profile.bootstrap(frame(spark, texts), 25).collect()}
    assert set(got) == {0, 1, 2}
    one = frame(spark, texts[:1]).select(F.transform(profile.token_lists(tx.sentences(F.col("text"))), F.array_distinct).alias("s")).first().s
    raw, n = [], len(one)
    for b in range(1, 26):
        picked = [one[int(hashlib.md5(f"42|0|{b}|{i}".encode()).hexdigest()[:8], 16) % n] for i in range(n)]
        raw.append(spark.createDataFrame([(0, i, p) for i, p in enumerate(picked)], "doc_id bigint, pos int, a array<string>").transform(lambda d: profile.set_cohesion(d, 0.35, ("doc_id",))).first().raw if b <= 3 else None)
    values = sorted(frame(spark, texts[:1]).select(hashing.resampled_cohesion(F.col("doc_id"), F.transform(profile.token_lists(tx.sentences(F.col("text"))), F.array_distinct), 25, 0.35, 42).alias("r")).first().r)
    assert all(any(v == pytest.approx(x) for v in values) for x in raw[:3])
    assert (got[0].ci_low, got[0].ci_high, got[0].std, got[0].samples) == (pytest.approx(np.percentile(values, 2.5)), pytest.approx(np.percentile(values, 97.5)), pytest.approx(np.std(values)), 25)
