import random
from itertools import combinations

import pytest

from termweave.llm import leakage

RNG = random.Random(7)
VOCAB = [f"w{a}{b}ord" for a in "abcdefgh" for b in "klmnopqrs"]


def item(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCAB) for _ in range(n))


ITEMS = [(i, item(40, i)) for i in range(1, 6)] + [(9, None), (10, ""), (11, item(8, 99))]


def changed(text, share, seed):
    rng = random.Random(seed)
    return " ".join("changed" if rng.random() < share else w for w in text.split())


FILL = " ".join(f"filler{i}" for i in range(60))
TEXT = {k: t for k, t in ITEMS}
DOCS = [
    (1, f"{FILL} {TEXT[1]} {FILL}"), (2, f"{FILL} {TEXT[2].upper().replace(' ', '  ')} {FILL}"), (3, "<p>" + TEXT[3].replace(" w", " <b>w</b> w", 0) + "</p>"),
    (4, " ".join(w[:2] + "­" + w[2:] for w in TEXT[4].split())), (5, f"{FILL} " + " ".join(TEXT[5].split()[10:26]) + f" {FILL}"),
    (6, f"{FILL} " + " ".join(TEXT[1].split()[:9]) + f" {FILL}"), (7, None), (8, ""), (9, FILL), (10, "_".join(TEXT[2].split())), (11, "*".join(TEXT[1].split())),
    (12, " ".join(w + (" [12]" if i % 4 == 0 else "") for i, w in enumerate(TEXT[3].split()))), (13, "-\n".join([TEXT[4][:81], TEXT[4][81:]])), (14, FILL + " " + changed(TEXT[5], 0.18, 4)),
    (15, FILL * 400 + " " + TEXT[2]), (16, TEXT[11]), (17, item(60, 1234)), (18, TEXT[1] + " " + TEXT[2]),
]
WANT = {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (10, 2), (11, 1), (12, 3), (13, 4), (14, 5), (15, 2), (16, 11), (18, 1), (18, 2)}


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in DOCS], "doc_id long, text string, item_id string"), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block", [20_000, 2])
def test_found(frames, block):
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(*frames, "doc_id", "text", "item_id", "text", block=block).collect()}
    assert got == WANT


def test_removed(frames):
    docs, items = frames
    leaks = leakage.find_passages(docs, items, "doc_id", "text", "item_id", "text")
    left = {r["doc_id"]: r["text"] for r in leakage.without_leaks(docs, leaks, "doc_id", "text").collect()}
    assert len(left) == len(DOCS) and left[1].split() == (FILL + " " + FILL).split() and left[9] == FILL
    assert leakage.find_leaks(leakage.without_leaks(docs, leaks, "doc_id", "text"), items, "doc_id", "text", "item_id", "text").count() == 0
    assert {r["doc_id"] for r in leakage.without_leaks(docs, leaks, "doc_id", "text", whole=True).collect()} == {k for k, _ in DOCS} - {k for k, _ in WANT}


def test_empty(frames):
    docs, items = frames
    assert leakage.find_leaks(docs.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
    assert leakage.find_leaks(docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_words():
    assert leakage.words("<i>Caf́e</i>, Über-\nmut [3] x_y​z")[0] == ["cafe", "ubermut", "x", "yz"]


def fewest_changed(flags):
    """The least share of changed words in a stretch of 15 or more that begins and ends unchanged."""
    kept = [i for i, f in enumerate(flags) if not f]
    return min((sum(flags[a : b + 1]) / (b - a + 1) for a in kept for b in kept if b - a >= 14), default=1.0)


def test_short_altered_passages():
    """Every passage of 15 words or more with one word in five changed is found, wherever the changes lie."""
    rng = random.Random(3)
    vocab = [f"w{i}{a}ord" for i in range(200) for a in "abc"]
    item_words, fill = [rng.choice(vocab) for _ in range(60)], FILL.split()
    items = leakage.Items([(1, " ".join(item_words))])

    def found(words):
        return bool(items.search([" ".join(fill + words + fill)]))

    cases = [[i in at for i in range(n)] for n, c in ((15, 2), (15, 3)) for at in combinations(range(n), c)]
    cases += [[i in at for i in range(n)] for n, c in ((18, 4), (20, 4)) for at in (set(rng.sample(range(n), c)) for _ in range(300))]
    # Three changes at the ends alone leave twelve words as they were, a shorter quotation.
    cases = [c for c in cases if any(c[c.index(False) : len(c) - c[::-1].index(False)]) or sum(c) < 3]
    cases += [c for c in ([rng.random() < 0.2 for _ in range(30)] for _ in range(300)) if fewest_changed(c) <= 0.25]
    lost = [c for c in cases if not found(["changed" if f else w for f, w in zip(c, item_words[20:])])]
    assert not lost
    assert not found(item_words[20:32]) and not found(["changed" if i % 5 in (1, 3) else w for i, w in enumerate(item_words[20:40])])
    dropped = item_words[20:23] + item_words[24:29] + ["more"] + item_words[29:31] + ["changed"] + item_words[32:36]
    assert found(dropped)


def test_overlapping_spans(spark):
    """Passages that overlap, touch or lie in one another are cut out as one; nothing else goes."""
    text = "".join(chr(97 + i % 26) for i in range(100))
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 30, 60), (1, 10, 50), (1, 20, 25), (1, 60, 62), (1, 90, 100)], "doc_id long, begins int, ends int")
    left = {r["doc_id"]: r["text"] for r in leakage.without_leaks(docs, spans, "doc_id", "text").collect()}
    assert left == {1: text[:10] + text[62:90], 2: text, 3: None, 4: ""}


def test_every_copy_and_short_items(spark):
    """A text may hold an item several times; items of a few words count where they are held whole."""
    short = [(21, "kumquat"), (22, "velvet anvil"), (23, "seven grey herons"), (24, "all maps lie here"), (25, "never trust a quiet harbour"), (26, "one two three four five six seven eight nine ten")]
    items = spark.createDataFrame(ITEMS[:3] + short, "item_id long, text string")
    texts = [
        (1, f"{TEXT[1]} {FILL} {TEXT[1]}"), (2, f"{TEXT[1]} {TEXT[1]} {TEXT[1]}"), (3, "A KUMQUAT, and a velvet-anvil!"), (4, "Seven grey herons; all maps lie, here"), (5, "velvet red anvil, seven herons, all maps lie"),
        (6, "x never trust the quiet harbour y never trust a quiet harbour"), (7, "one two three four FIVE six sevn eight nine ten; one two three four five"), (8, f"{TEXT[1]} {TEXT[2]} {FILL} {changed(TEXT[1], 0.15, 2)}"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = leakage.find_passages(docs, items, "doc_id", "text", "item_id", "text").collect()
    count = {}
    for r in rows:
        count[r["doc_id"], r["item_id"]] = count.get((r["doc_id"], r["item_id"]), 0) + 1
    assert count == {(1, 1): 2, (2, 1): 3, (3, 21): 1, (3, 22): 1, (4, 23): 1, (4, 24): 1, (6, 25): 2, (7, 26): 1, (8, 1): 2, (8, 2): 1}
    cleaned = leakage.without_leaks(docs, spark.createDataFrame(rows), "doc_id", "text")
    assert leakage.find_passages(cleaned, items, "doc_id", "text", "item_id", "text").count() == 0
    assert {r["doc_id"]: r["text"].split() for r in cleaned.collect()}[1] == FILL.split()


def test_pattern_of_another_item():
    """Where a text holds one item, another one made after the same pattern is not leaked; an equal part of both is."""
    pattern = "why did the {} miller of {} trade exactly {} grams of {} salt for the {} bell before {} came home again"
    one = pattern.format("old", "Vorn", 31, "grey", "small", 1911)
    two = pattern.format("young", "Kelt", 87, "red", "large", 1955)
    items = leakage.Items([(1, one), (2, two), (3, f"{one} and then he left the town for ever")])
    assert {items.keys[r[1]] for r in items.search([f"{FILL} {one} {FILL}"])} == {1, 3}


@pytest.mark.parametrize("block", [20_000, 1])
def test_pattern_over_blocks(spark, block):
    """Which items explain a passage does not depend on the blocks that items are searched in."""
    pattern = "why did the {} miller of {} trade exactly {} grams of {} salt for the {} bell before {} came home again"
    texts = [pattern.format("old", "Vorn", 31, "grey", "small", 1911), pattern.format("young", "Kelt", 87, "red", "large", 1955)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{FILL} {texts[0]} {FILL}"), (2, texts[1]), (3, f"{texts[1]} {FILL} {texts[0]}")], "doc_id long, text string")
    found = leakage.find_leaks(docs, items, "doc_id", "text", "item_id", "text", block=block)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 0), (2, 1), (3, 0), (3, 1)}
