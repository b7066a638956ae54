import pytest

from termweave.llm import encoding

CLEAN = ["Größe und Nutzen für Gärten", "Étude des égouts à l’été", "gestión pública y señales", "The council’s report – drafted “by hand”", "AVALIAÇÃO E MANUTENÇÃO: LÃ", "本文比较了雨水窖与绿色屋顶的成本，并指出若干差异。", "plain ascii & more"]


def damage(text, chain):
    steps = chain.split(">")
    for written, read in zip(steps[::2], steps[1::2]):
        text = encoding.wrongly_read(text.encode(written), read)
    return text


CHAINS = ["utf-8>cp1252", "utf-8>latin-1", "utf-8>cp1252>utf-8>cp1252", "utf-8>gb18030", "utf-8>mac_roman", "utf-8>cp437", "cp1252>mac_roman", "cp1252>cp1251", "cp1252>utf-8"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 3)]
    bad = [(100 + 10 * j + i, damage(t, c)) for j, c in enumerate(CHAINS) for i, t in enumerate(CLEAN[:4]) if damage(t, c) != t]
    bad += [(300 + j, damage(CLEAN[5], c)) for j, c in enumerate(("utf-8>cp1252", "gb18030>latin-1", "gb18030>big5"))]
    odd = [(900, None), (901, ""), (902, "na�ve"), (903, "word " * 50_000 + CLEAN[0])]
    return spark.createDataFrame([(k, t, "f") for k, t in rows + bad + odd], "k long, text string, field string"), {k for k, _ in bad}, rows, dict(bad)


def test_found(corpus):
    df, bad, rows, _ = corpus
    got = {r["k"] for r in encoding.find_garbled(df, "k", ["text"]).collect()}
    assert bad <= got
    assert not got & {k for k, _ in rows} and 900 not in got and 901 not in got and 902 in got and 903 not in got


def test_repaired(corpus):
    df, bad, _, texts = corpus
    got = {r["k"]: r["restored"] for r in encoding.repair_garbled(df, "k", ["text"]).collect()}
    lossless = [k for k, t in texts.items() if "�" not in t]
    right = sum(got[k] in CLEAN for k in lossless)
    assert right >= 0.8 * len(lossless)
    assert all(v is None or "�" not in v for v in got.values())


def test_empty(spark):
    assert encoding.find_garbled(spark.createDataFrame([], "k long, text string"), "k", ["text"]).count() == 0


@pytest.mark.parametrize("chain", CHAINS[:6])
def test_round_trip(chain):
    text = CLEAN[0]
    assert encoding.repair(damage(text, chain), [chain]) == text
    assert damage(text, chain) in {f for f, _ in encoding.garbled_forms(text)}


def test_mostly_damaged(spark):
    """A source delivered wrongly read outweighs the sound values of a word; its values are found and repaired all the same."""
    text, other = "Größe der Gärten", "schön grün"
    rows = [(0, text), (1, "hö è û"), (2, "ü ä")] + [(10 + i, damage(text, c)) for i, c in enumerate(("utf-8>cp1252", "utf-8>latin-1", "utf-8>cp437") * 4)]
    rows += [(30 + i, damage(other, "utf-8>cp1252")) for i in range(9)] + [(50 + i, "«A IRMÃ» e “AMANHÃ”, LÃ²") for i in range(5)]
    df = spark.createDataFrame(rows, "k long, text string")
    got = {r["k"]: r["restored"] for r in encoding.repair_garbled(df, "k", ["text"]).collect()}
    assert got == {k: text if k < 30 else other for k, _ in rows if 10 <= k < 50}
