import random
import re

from quillgraph.llm.decontam import annotate, remove

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items, window=10):
    w = words(text)
    hit, found = set(), set()
    for name, item in items:
        v = words(item)
        n = min(len(v), window)
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                if name is not None:
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(12)] + ["Übung", "x1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(25)]
    items += [(7, "second text of an id that repeats itself in the table twice over"), (None, "no id but words that are long enough to make one whole window"), (90, None), (91, "..."), (92, "")]
    docs = []
    for _ in range(80):
        t = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            t[rng.randrange(len(t) + 1) : 0] = (rng.choice(items)[1] or "").upper().split()
        docs.append(", ".join(t))
    return docs + ["", None, "?!", items[25][1], items[26][1], "v1 " * 30_000], items


def test_as_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1_000_000, 40):  # one automaton, and several
        got = {r.doc_id: r for r in annotate(df, bench, max_words=most).collect()}
        for i, t in enumerate(docs):
            assert (got[i].n_words, got[i].n_hit, got[i].hit_items) == brute(t, items), (most, i)


def test_remove_spans_and_documents(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before, {item.upper()}! After it comes " + "more text " * 20, "k"), (2, item, "k"), (3, "clean text", "k"), (4, None, None), (5, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in remove(annotate(df, spark.createDataFrame([(1, item)], "item_id long, text string"))).collect()}
    assert set(out) == {1, 3, 4, 5}
    assert out[1].startswith("Before, ! After it comes more") and out[3] == "clean text" and out[4] is None and out[5] == ""


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert annotate(df, bench).first().n_hit == 0
    assert annotate(df.where("false"), bench).count() == 0


def test_an_item_larger_than_an_automaton(spark):
    words = [f"w{i}" for i in range(400)]
    docs = [" ".join(words[a : a + n]) for a, n in ((0, 400), (35, 12), (50, 9), (391, 9), (380, 20))] + ["w1 w2"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = [(1, " ".join(words)), (2, "w1 w2")]
    got = {r.doc_id: r for r in annotate(df, spark.createDataFrame(items, "item_id long, text string"), max_words=210).collect()}
    for i, t in enumerate(docs):
        assert (got[i].n_words, got[i].n_hit, got[i].hit_items) == brute(t, items)


def test_size_of_an_automaton():
    import pickle
    import random

    from quillgraph.llm.decontam import SuffixAutomaton

    rng = random.Random(1)
    items = [(str(k), [b"word%d" % rng.randrange(5_000) for _ in range(50)]) for k in range(400)]
    assert len(pickle.dumps(SuffixAutomaton(items, 10))) <= 100 * 20_000 + 100 * 5_000
