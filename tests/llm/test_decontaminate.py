import hashlib
import random
import re

from tidemark.llm.decontaminate import contamination_report, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    windows = {}
    for i, text in items:
        ws = lower(text)
        n = min(window, len(ws))
        for at in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[at:at + n]), set()).add(i)
    rows = []
    for d, text in docs:
        ws, hit, met = lower(text), set(), set()
        for n in {len(w) for w in windows}:
            for at in range(len(ws) - n + 1):
                if tuple(ws[at:at + n]) in windows:
                    hit.update(range(at, at + n))
                    met |= windows[tuple(ws[at:at + n])]
        ids = sorted(str(i) for i in met if i is not None)
        rows.append((d, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                     bool(hit) and 20 * len(hit) >= len(ws)))
    return rows


def cases(seed, letters, n_items, longest):
    rng = random.Random(seed)
    items = [" ".join(rng.choice(letters) for _ in range(rng.randrange(0, longest))) for _ in range(n_items)]
    docs = []
    for _ in range(120):
        parts = [rng.choice(items) if rng.random() < .3 else " ".join(rng.choice(letters) for _ in range(9)) for _ in range(rng.randrange(6))]
        words = " ".join(parts).split()
        cut = rng.randrange(1 + len(words) // 3)
        docs.append(rng.choice([". ", " ", "--"]).join(words[cut:]).upper())
    return docs, items


def test_equals_brute_force(spark, documents):
    for seed, letters, n, longest in [(1, "ab", 6, 30), (2, "abcdefghij", 12, 40), (3, "abé日x", 9, 20)]:
        texts, items = cases(seed, letters, n, longest)
        texts += ["", None, " .,", "q" * 3000 + " b" * 4000]
        items += ["", None, items[0], "Zebra"]
        pairs = list(enumerate(items)) + [(None, "only the item without an id " * 3)]
        bench = spark.createDataFrame(pairs, "item_id bigint, text string")
        texts.append("x only the item without an id only the item without an id y zebra")
        got = sorted(tuple(r) for r in contamination_report(documents(*texts), bench).collect())
        assert got == brute(list(enumerate(texts)), pairs)


def test_spans_are_cut(spark, documents):
    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    long = "pad " * 400 + item.upper() + " tail"
    rows = {r.doc_id: r for r in decontaminate(documents(long, item, None), bench).collect()}
    assert rows[0].cleaned == "pad " * 400 + " tail" and not rows[0].contaminated and rows[0].item_ids == ["5"]
    assert rows[1].contaminated and rows[1].cleaned is None
    assert rows[2].text is None and rows[2].cleaned is None and rows[2].n_words == 0


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert not contamination_report(documents("a b"), bench).first().contaminated
    assert contamination_report(documents("a").limit(0), bench).count() == 0
