import random
import re

import corpus_pipeline
from quillgraph.llm.common import cut


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(4)
    words = [a + b for a in ("ri", "sto", "li", "ha", "mo", "pa", "gre") for b in ("ver", "ne", "ght", "use", "per", "en")]

    def prose(n=150):
        return " ".join(rng.choice(words) for _ in range(n)) + "."

    texts = [prose() if i % 4 else " | ".join(rng.choice(["BUY!!", "$$$", "free%%%", "now***"]) for _ in range(150)) for i in range(200)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(200)]
    copy = prose(200)
    item = prose(30)
    texts += [copy, copy, copy + " more", prose() + " " + item + " " + prose(), prose() + " mail jo.doe@example.com now", prose(300)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, str(tmp_path)))
        sizes.append(docs.count())
        assert docs.columns == names or k == len(corpus_pipeline.STAGES) - 1
    got = {r.doc_id: r for r in docs.collect()}
    assert not any(i in got for i in range(0, 200, 4)) and all(i in got for i in range(200) if i % 4)
    assert 200 in got and 201 not in got and 202 not in got
    assert item[:-1] not in got[203].text and got[203].n_chars == len(got[203].text)
    assert "<email>" in got[204].text and "jo.doe" not in got[204].text
    assert got[205].text == texts[205]
    assert sizes == sorted(sizes, reverse=True) and len({r.position for r in got.values()}) == len(got)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(got)


def test_empty_tables(spark, tmp_path):
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    some = [(i, f"text of the document number {i} " * 9, "en", "s", 9) for i in range(6)] + [(None, None, None, None, None), (7, "", "en", None, 0)]
    for k, rows in enumerate(([], some)):
        place = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, docs).write.parquet(f"{place}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
        got = corpus_pipeline.run(spark, place).collect()
        assert len(got) == len(rows)  # without labels and items nothing is rejected; these texts are not near copies


def test_each_stage_as_brute_force(spark):
    """Every stage over what the last one kept of a whole table, against plain Python."""
    from pyspark.sql import functions as F

    from quillgraph.llm import pii, quality
    from tests.llm.test_neardup import brute as same
    from tests.llm.test_pii import BASE
    from tests.llm.test_pii import brute as personal

    place = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{place}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}

    one = cut(stages["quality classifier"](spark, docs, place))
    kept = {r.doc_id: r.text for r in one.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{place}/labels.parquet"), F.lit(True))
    assert kept == {i: t for i, t in given.items() if model.score(t) >= corpus_pipeline.QUALITY}

    two = cut(stages["MinHash near-dedup"](spark, one, place))
    ids = sorted(kept)
    classes = same([kept[i] for i in ids], 5)
    single = {i: kept[i] for k, i in enumerate(ids) if classes[k][1] == k}
    assert {r.doc_id: r.text for r in two.collect()} == single

    three = cut(stages["benchmark decontamination"](spark, two, place))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    windows: dict[int, set[tuple[str, ...]]] = {}
    for r in spark.read.parquet(f"{place}/benchmark.parquet").collect():
        own = word.findall((r.text or "").translate(lower))
        size = min(len(own), 10)
        for a in range(len(own) - size + 1 if own else 0):
            windows.setdefault(size, set()).add(tuple(own[a : a + size]))
    clean = {}
    for i, text in single.items():
        at = [m.span() for m in word.finditer((text or "").translate(lower))]
        said = [text.translate(lower)[a:b] for a, b in at]
        hit = {p for size, some in windows.items() for a in range(len(said) - size + 1) if tuple(said[a : a + size]) in some for p in range(a, a + size)}
        if len(hit) > 0.5 * len(said):
            continue
        out, end = [], 0
        runs = sorted(p for p in hit if p - 1 not in hit)
        for start in runs:
            last = start
            while last + 1 in hit:
                last += 1
            out.append(text[end : at[start][0]])
            end = at[last][1]
        clean[i] = "".join([*out, text[end:]]) if hit else text
    assert {r.doc_id: r.text for r in three.collect()} == clean

    four = cut(stages["PII"](spark, three, place))
    spans = {r.doc_id: r.pii for r in pii.find(three).collect()}
    redacted = {}
    for i, text in clean.items():
        base = [x for x in personal(text).split(",") if x]
        assert {f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in spans[i] if s.base} == set(base)
        out, end = [], 0
        for s in spans[i]:
            if s.start >= end:
                out += [text[end : s.start], f"<{pii.KINDS[s.kind]}>"]
            end = max(end, s.end)
        redacted[i] = "".join([*out, text[end:]]) if spans[i] else text
    assert {r.doc_id: r.text for r in four.collect()} == redacted
    assert any(text != clean[i] for i, text in redacted.items()) and len(BASE) == 4

    five = stages["mixing sources to target weights"](spark, four, place).collect()
    assert {r.doc_id: r.text for r in five} == redacted and len({r.position for r in five}) == len(five)
    assert sorted(map(str, five)) == sorted(map(str, corpus_pipeline.run(spark, place).collect()))
