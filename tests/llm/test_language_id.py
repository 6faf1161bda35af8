from pyspark.sql import functions as F

from folio.llm import language_id
from folio.llm.queries import op8_language_id
from tests.llm.cases import ROWS, frame


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op8_language_id(spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95


def test_edge_cases(spark):
    docs = frame(spark)
    got = language_id.identify(docs, language_id.learn(docs)).collect()
    assert len(got) == len(ROWS) and set(docs.columns) <= set(got[0].asDict())
    for r in got:
        no_letter = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == no_letter and (not no_letter or (r.score == 0 and r.rejected))
        assert 0 <= r.score <= 1


def test_nothing_learned_and_empty(spark):
    docs = frame(spark)
    assert language_id.learn(docs.limit(0)) == {}
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), {"en": b"abc"}).count() == 0


def test_dictionaries_are_bounded(spark, small):
    held = language_id.learn(spark.read.parquet(f"{small}/documents.parquet"), dictionary_bytes=5000)
    assert held and all(len(x) <= 5001 + len(x) // 1000 for x in held.values())


def test_a_tie_goes_to_the_first_and_is_rejected():
    model = language_id.Classifier({"b": b"same words here", "a": b"same words here"})
    assert model.predict("same words here") == ("a", 0.0)


def test_folds(spark):
    import zlib

    got = spark.range(100).select("id", language_id.held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def by_force(text, dictionaries):
    """Each block compressed on its own by a fresh compressor; the smallest total wins."""
    import zstandard

    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    totals = []
    for name in sorted(dictionaries):
        held = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        total = 0
        for at in range(0, len(text), 2048):
            maker = zstandard.ZstdCompressor(level=9, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
            total += len(maker.compress(text[at : at + 2048].encode()))
        totals.append((total, name))
    totals.sort()
    return totals[0][1], (totals[1][0] - totals[0][0]) / totals[1][0]


def test_registered_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    inside = docs.where(~language_id.held_out(F.col("doc_id")))
    dictionaries = language_id.learn(inside)
    want = {r.doc_id: by_force(r.text, dictionaries) for r in docs.collect()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in op8_language_id(spark, small).collect()}
    assert got == want


def test_excerpts_lie_anywhere_in_whole_texts(spark):
    """Dictionaries by plain Python: documents in the order of their hash, each from its own place."""
    rows = [(i, f"{i} start " + " ".join(f"w{i}x{n}" for n in range(900)) + f" end {i}", "en" if i % 3 else "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.learn(docs)
    hashes = {r.id: (r.key, r.place) for r in docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.col("doc_id").cast("string")).alias("key"), F.xxhash64(F.col("doc_id").cast("string"), F.lit("place")).alias("place")).collect()}
    for lang in ("en", "de"):
        want = b""
        for i, text, _ in sorted((r for r in rows if r[2] == lang), key=lambda r: hashes[r[0]][0]):
            at = hashes[i][1] % max(1, len(text) - language_id.EXCERPT + 1)
            want += text[at : at + language_id.EXCERPT].encode() + b"\n"
        assert got[lang] == want


def test_margins_reject_no_language_and_keep_clean_texts(spark):
    import random

    random.seed(2)
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inside = docs.where(~language_id.held_out(F.col("doc_id")))
    dictionaries = language_id.learn(inside)
    margins = language_id.calibrate(inside, dictionaries)
    assert margins and all(0 < m < 0.2 for m in margins.values())
    held = language_id.identify(docs.where(language_id.held_out(F.col("doc_id"))), dictionaries, margins=margins).where("lang_pred = lang").collect()
    assert sum(r.rejected for r in held) <= 0.02 * len(held)
    junk = [(i, "".join(random.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(1500))) for i in range(60)]
    found = language_id.identify(spark.createDataFrame(junk, "doc_id long, text string"), dictionaries, margins=margins).collect()
    assert sum(r.rejected for r in found) > 45
    short = language_id.identify(spark.createDataFrame([(1, "Von."), (2, "That it.")], "doc_id long, text string"), dictionaries, margins=margins).collect()
    assert not any(r.rejected for r in short)
    assert language_id.calibrate(inside.limit(0), dictionaries) == {}


def test_length_classes(spark):
    for chars in (1, 2, 3, 4, 31, 32, 1023, 1024, 5000):
        assert language_id.length_class(chars) == spark.sql(f"SELECT cast(floor(log2({chars}D)) AS int) + 1 AS c").first().c


def labelled_texts(n):
    """Texts of two languages that share words, so that leads differ; of two lengths, and a few long ones.

    The last five are as long and of shared words only, without a label."""
    import random

    r = random.Random(11)
    made = lambda n: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(n)]
    both, own = made(30), {"de": made(60), "en": made(60)}
    out = []
    for i in range(n):
        lang = ("de", "en")[i % 2]
        share = r.random() / 2
        words = [r.choice(own[lang]) for _ in range(100)] if i % 400 < 2 else [r.choice(both if r.random() < share else own[lang]) for _ in range(r.choice((6, 20)))]
        out.append((i, " ".join(words), lang, "a", 0))
    return out + [(n + i, " ".join(r.choice(both) for _ in range(80)), None, "a", 0) for i in range(5)]


def margins_by_force(rows, dictionaries):
    model, scores = language_id.Classifier(dictionaries), {}
    for _, text, lang, *_ in rows:
        pred, score = model.predict(text)
        if pred == lang:
            scores.setdefault(len(text).bit_length(), []).append(score)
    low = {c: sorted(s)[-(-len(s) // 100) - 1] for c, s in scores.items() if len(s) >= language_id.MARGIN_ROWS}
    return {c: language_id.MARGIN_SHARE * x for c, x in low.items() if x > 0}


def test_margins_come_from_all_labelled_rows(spark):
    """Of 15,000 labelled documents each counts: no sample, no approximate rank, in whatever partitions they lie."""
    rows = labelled_texts(15_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    dictionaries = language_id.learn(docs, dictionary_bytes=3000)
    want = margins_by_force(rows, dictionaries)
    assert 10 in want and len(want) >= 2
    assert language_id.calibrate(docs, dictionaries) == want == language_id.calibrate(docs.repartition(7), dictionaries)


def test_stage_keeps_what_margins_of_all_labelled_rows_allow(spark):
    import corpus_pipeline

    rows = labelled_texts(9000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    fold = {r.doc_id for r in docs.where(language_id.held_out(F.col("doc_id"))).collect()}
    dictionaries = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    margins = margins_by_force([r for r in rows if r[0] not in fold], dictionaries)
    model = language_id.Classifier(dictionaries)
    want = [r for r in rows if model.predict(r[1])[1] >= margins.get(len(r[1]).bit_length(), 0)]
    assert 0 < len(want) < len(rows) and rows[-1] not in want
    assert sorted(map(tuple, corpus_pipeline.identify_language(spark, docs, "").collect())) == want


def test_judging_is_learning_calibrating_and_identifying(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, "no id but words", "en"), (1_000_000, "no language but words", None), (1_000_001, None, "en"), (1_000_002, "12 34", "de")], docs.schema)
    docs, learned = docs.unionByName(odd), ~language_id.held_out(F.col("doc_id"))
    dictionaries = language_id.learn(docs.where(learned))
    margins = language_id.calibrate(docs.where(learned), dictionaries)
    want = language_id.identify(docs, dictionaries, margins=margins)
    got = language_id.judge(docs, learned, keep=["doc_id", "text", "lang"])
    assert margins and got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
