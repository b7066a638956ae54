"""Languages of documents and of their lines: interpolated Kneser-Ney character language models.

One model per language is trained on labelled samples. The n-grams of all languages lie in one sorted array of hashes per
order, beside a matrix of log probabilities and back-off weights with one column per language; a batch of lines is scored by
binary search on all its positions at once. A line takes the language of the lowest cross-entropy per character; a document
is mixed where a line is explained clearly better by another language than by the document's. Confidence is the calibrated
posterior; texts that no model explains are rejected. Temperature and rejection are calibrated on held-out samples.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.session import spread

#: Characters per n-gram; labelled samples used for training at most (the first by hash of their text).
ORDER, MOST_SAMPLES = 5, 20_000
#: A line differs from its document if another language explains it better by so many nats in all and per character.
MARGIN, MARGIN_PER_CHAR = 16.0, 0.12
#: Calibration: parts of the samples that are held out in turn; words of the pieces whose posteriors are tempered; the share of
#: unseen words of a language that its model must explain.
FOLDS, PIECES, EXPLAINED = 5, (1, 2, 4, 8, 16), 0.99
#: Code points at which scripts begin; neighbouring ranges of one kind are one script for our purpose. Fixed values.
SCRIPTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0x1100, 0x1E00, 0x1F00, 0x2E80, 0x3040, 0x3100, 0xAC00, 0xD7B0, 0xF900, 0xFB00)

#: Names and codes of the languages told apart. Fixed values.
LABELS = {
    "en": "en eng english anglais englisch ingles",
    "de": "de deu ger german deutsch allemand aleman",
    "fr": "fr fra fre french francais franzosisch frances",
    "es": "es spa spanish espanol castellano spanisch espagnol",
    "pt": "pt por portuguese portugues portugiesisch portugais",
    "nl": "nl nld dut dutch nederlands niederlandisch flemish neerlandais",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 chinesisch chinois zhongwen",
}
#: Labels that name no language. Fixed values.
NO_LABEL = ("", "und", "unknown", "n/a", "na", "none", "null", "mul", "zxx", "mis", "other", "?", "-", "xx", "undetermined", "unk")

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


def _letters() -> np.ndarray:
    """Maps code units below 65536 to lower-case letters, and everything else to a space."""
    table = np.full(65536, _SPACE, np.uint32)
    for c in range(65536):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 65536 else c
    table[ord("’")] = table[ord("'")] = ord("'")
    return table


_TABLE: np.ndarray | None = None
_SCRIPT: np.ndarray | None = None


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each preceded by a space, and the texts' starts: lower case, other characters one space."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _letters()
    raw = np.frombuffer("\0".join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    # Beyond the table lie rare Chinese characters, which are letters, and signs.
    chars = np.where(raw < 65536, _TABLE[np.minimum(raw, 65535)], np.where((raw >= 0x20000) & (raw < 0x40000), raw, _SPACE)).astype(np.uint32)
    start = raw == 0
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != _SPACE) | (chars[:-1] != _SPACE) | start[1:]
    where = np.flatnonzero(start[keep])
    if len(where) != len(texts):  # a text holds the separator itself
        return encode([t.replace("\0", " ") for t in texts])
    return chars[keep], where


def hashes(chars: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order n the hash of the n characters that end at each position; shorter ones at a text's beginning."""
    out = []
    with np.errstate(over="ignore"):
        one = (chars.astype(np.uint64) + np.uint64(1)) * _MULT
        one ^= one >> np.uint64(29)
        begin = np.zeros(len(chars), np.int64)
        begin[starts] = starts
        begin = np.maximum.accumulate(begin)
        depth = np.arange(len(chars)) - begin
        now = one
        out.append(now)
        for n in range(1, order):
            longer = np.zeros_like(now)
            longer[n:] = one[:-n]
            mixed = (now * np.uint64(0xBF58476D1CE4E5B9)) ^ (longer + np.uint64(n))
            mixed ^= mixed >> np.uint64(31)
            now = np.where(depth >= n, mixed, now)
            out.append(now)
    return out


@dataclass
class Model:
    """Sorted hashes per order, with log probabilities and back-off weights of all languages."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None
    #: Per language the scripts of its samples, and the nats per character beyond which it explains nothing; the temperature.
    scripts: np.ndarray | None = None
    reject: np.ndarray | None = None
    temper: float = 1.0

    def score(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log likelihood of each text under each language."""
        size = len(chars)
        top, found = np.full(size, -1, np.int8), []
        for n, h in enumerate(hashes(chars, starts, len(self.keys))):
            # An n-gram is known only where its last n - 1 characters are.
            where = np.flatnonzero(top == n - 1)
            key = h[where]
            at = np.minimum(np.searchsorted(self.keys[n], key), len(self.keys[n]) - 1)
            hit = self.keys[n][at] == key
            place = np.full(size, -1, np.int32)
            place[where[hit]] = at[hit]
            top[where[hit]] = n
            found.append(place)
        total = np.empty((size, len(self.languages)), np.float32)
        total[top < 0] = self.floor
        for n, place in enumerate(found):
            here = np.flatnonzero(top == n)
            total[here] = self.logp[n][place[here]]
        for n in range(1, len(found)):
            before = found[n - 1]
            miss = np.flatnonzero((top[1:] < n) & (before[:-1] >= 0))
            total[miss + 1] += self.back[n - 1][before[miss]]
        total[starts] = 0  # the space before a text is given
        return np.add.reduceat(total, starts, axis=0)


def train(samples: list[tuple[str, str]], order: int = ORDER) -> Model:
    """Models of (language, text) samples: interpolated Kneser-Ney with one discount per order."""
    languages = sorted({lang for lang, _ in samples})
    model = Model(languages)
    per: list[list[dict]] = []
    for lang in languages:
        chars, starts = encode([text for x, text in samples if x == lang])
        hs = hashes(chars, starts, order)
        begin = np.zeros(len(chars), np.int64)
        begin[starts] = starts
        depth = np.arange(len(chars)) - np.maximum.accumulate(begin)
        tables = []
        for n in range(order):
            use = depth >= max(n, 1)
            idx = np.flatnonzero(use)
            ctx = hs[n - 1][idx - 1] if n else np.zeros(len(idx), np.uint64)
            low = hs[n - 1][idx] if n else np.zeros(len(idx), np.uint64)
            key, first, count = np.unique(hs[n][idx], return_index=True, return_counts=True)
            tables.append({"key": key, "ctx": ctx[first], "low": low[first], "count": count.astype(np.float64)})
        # Continuation counts of the lower orders: in how many different contexts to the left an n-gram occurs.
        for n in range(order - 1):
            low, n_left = np.unique(tables[n + 1]["low"], return_counts=True)
            t = tables[n]
            at = np.minimum(np.searchsorted(low, t["key"]), len(low) - 1)
            t["count"] = np.where(low[at] == t["key"], n_left[at], 1).astype(np.float64) if len(low) else t["count"]
        below_key, below_p = None, None
        size = max(2, len(tables[0]["key"]))
        for n, t in enumerate(tables):
            n1, n2 = (t["count"] == 1).sum(), (t["count"] == 2).sum()
            discount = min(0.95, max(0.3, n1 / (n1 + 2 * n2) if n1 else 0.5))
            ctx, inverse = np.unique(t["ctx"], return_inverse=True)
            total = np.bincount(inverse, t["count"])
            kinds = np.bincount(inverse)
            weight = discount * kinds / total
            if n == 0:
                lower = np.full(len(t["key"]), 1 / (size + 200))
            else:
                at = np.minimum(np.searchsorted(below_key, t["low"]), len(below_key) - 1)
                lower = np.where(below_key[at] == t["low"], below_p[at], 1e-7)
            p = np.maximum(t["count"] - discount, 0) / total[inverse] + weight[inverse] * lower
            t |= {"p": p, "contexts": ctx, "weight": weight}
            below_key, below_p = t["key"], p
        tables[0]["unknown"] = tables[0]["weight"][0] / (size + 200)
        per.append(tables)
    model.floor = np.log([t[0]["unknown"] for t in per]).astype(np.float32)
    # Join the languages: an n-gram that one of them lacks has its backed-off probability there.
    for n in range(order):
        keys = np.unique(np.concatenate([t[n]["key"] for t in per]))
        low = np.zeros(len(keys), np.uint64)
        ctx = np.zeros(len(keys), np.uint64)
        for t in per:
            at = np.searchsorted(keys, t[n]["key"])
            low[at], ctx[at] = t[n]["low"], t[n]["ctx"]
        logp = np.empty((len(keys), len(languages)), np.float32)
        for j, t in enumerate(per):
            if n == 0:
                base = np.full(len(keys), model.floor[j], np.float32)
            else:
                at = np.minimum(np.searchsorted(model.keys[n - 1], low), len(model.keys[n - 1]) - 1)
                base = np.where(model.keys[n - 1][at] == low, model.logp[n - 1][at, j], model.floor[j])
                c = np.minimum(np.searchsorted(t[n]["contexts"], ctx), len(t[n]["contexts"]) - 1)
                base = base + np.where(t[n]["contexts"][c] == ctx, np.log(t[n]["weight"][c]), 0)
            logp[:, j] = base
            at = np.searchsorted(keys, t[n]["key"])
            logp[at, j] = np.log(t[n]["p"])
        model.keys.append(keys)
        model.logp.append(logp)
    for n in range(order - 1):
        back = np.zeros((len(model.keys[n]), len(languages)), np.float32)
        for j, t in enumerate(per):
            c = np.minimum(np.searchsorted(t[n + 1]["contexts"], model.keys[n]), len(t[n + 1]["contexts"]) - 1)
            back[:, j] = np.where(t[n + 1]["contexts"][c] == model.keys[n], np.log(t[n + 1]["weight"][c]), 0)
        model.back.append(back)
    return model


def script_of(chars: np.ndarray) -> np.ndarray:
    """Number of each character's script; extensions of Latin and Chinese count with their script, spaces are -1."""
    global _SCRIPT
    if _SCRIPT is None:
        code, of = np.arange(65536), {x: i for i, x in enumerate(SCRIPTS)}
        _SCRIPT = (np.searchsorted(np.array(SCRIPTS), code, "right") - 1).astype(np.int8)
        _SCRIPT[np.isin(_SCRIPT, (of[0x1E00], of[0xFB00]))] = 0
        _SCRIPT[np.isin(_SCRIPT, (of[0x3100], of[0xF900]))] = of[0x2E80]
        _SCRIPT[[_SPACE, ord("'")]] = -1
    return np.where(chars < 65536, _SCRIPT[np.minimum(chars, 65535)], SCRIPTS.index(0x2E80))


def _shares(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Letters of each script in each text."""
    text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(chars))))
    slot = text * (len(SCRIPTS) + 1) + script_of(chars) + 1
    return np.bincount(slot, minlength=len(starts) * (len(SCRIPTS) + 1)).reshape(len(starts), -1)[:, 1:]


def _split(text: str) -> list[str]:
    """Words of a text; of text without spaces single characters."""
    return [w for part in text.split() for w in (list(part) if len(part) > 3 and any("\u2e80" <= c for c in part) else [part]) if any(map(str.isalpha, w))]


def calibrated(samples: list[tuple[str, str]], order: int = ORDER, folds: int = FOLDS) -> Model:
    """A model of all samples whose temperature and rejection come from held-out ones.

    Each part of the samples is held out in turn. The temperature makes the posteriors of its pieces of a few words most
    likely. A language explains a text within the nats per character that most of its words need that the other parts don't
    have: text all of whose words are new is still accepted. A text is also rejected where most of its letters are of scripts
    that the language's samples don't have.
    """
    model = train(samples, order)
    n = len(model.languages)
    chars, starts = encode([t for _, t in samples])
    own = np.array([model.languages.index(lang) for lang, _ in samples])
    model.scripts = np.stack([_shares(chars, starts)[own == j].sum(0) > 0 for j in range(n)])
    scores, truth, needs = [], [], [[] for _ in range(n)]
    for fold in range(min(folds, len(samples))):
        held = samples[fold::folds]
        rest = [x for i, x in enumerate(samples) if i % folds != fold]
        if {lang for lang, _ in rest} != set(model.languages):
            continue
        part = train(rest, order)
        seen = [{w for lang, t in rest if lang == x for w in _split(t)} for x in model.languages]
        texts, langs, news, news_of = [], [], [], []
        for lang, text in held:
            j, words = model.languages.index(lang), _split(text)
            glue = "" if words and len("".join(words)) == len(words) and len(words) > 1 else " "
            pieces = [glue.join(words[i : i + k]) for k in PIECES for i in range(0, len(words) - k + 1, k)]
            texts += pieces
            langs += [j] * len(pieces)
            new = [w for w in words if w not in seen[j]]
            news += new
            news_of += [j] * len(new)
        if texts:
            scores.append(part.score(*encode(texts)).astype(np.float64))
            truth.append(np.array(langs))
        if news:
            chars, starts = encode(news)
            length = np.maximum(np.diff(np.append(starts, len(chars))) - 1, 1)
            for j, x in zip(news_of, -part.score(chars, starts)[np.arange(len(news)), news_of] / length):
                needs[j].append(float(x))
    if scores:
        z, y = np.concatenate(scores), np.concatenate(truth)

        def loss(t: float) -> float:
            a = t * (z - z.max(1, keepdims=True))
            return float((np.log(np.exp(a).sum(1)) - a[np.arange(len(y)), y]).mean())

        model.temper = min(np.arange(0.05, 2.01, 0.05).tolist(), key=loss)
    every = [x for xs in needs for x in xs]
    most = float(np.quantile(every, EXPLAINED)) if every else float("inf")
    model.reject = np.array([float(np.quantile(xs, EXPLAINED)) if xs else most for xs in needs])
    return model


def label_language(col: Column) -> Column:
    """The code of the language that a label names; '' where it names none; the label itself for any other language."""
    plain = F.translate(F.lower(F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", " "))), "áàâãäçéèêëíìîïñóòôõöúùûü", "aaaaaceeeeiiiinooooouuuu")
    first = F.regexp_extract(plain, r"^([^\s_\-(;,/]+)", 1)
    out = F.when(plain.isin(*NO_LABEL), "").otherwise(first)
    for code, names in LABELS.items():
        out = F.when(first.isin(*names.split()), code).otherwise(out)
    return F.when(plain.isin(*NO_LABEL), F.lit("")).otherwise(out)


def judge(model: Model, texts: list[str | None]) -> list[tuple[str | None, float, bool, list[tuple[str, float]]]]:
    """(language, confidence, rejected, per line (language, confidence)) of each text; lines as in segments()."""
    lines, owner = [], []
    for i, text in enumerate(texts):
        for line in (text or "").split("\n"):
            if line.strip():
                lines.append(line)
                owner.append(i)
    if not lines:
        return [(None, 0.0, True, []) for _ in texts]
    out: list = []
    scores, lengths, shares = [], [], []
    step, size, k = [], 0, 0
    for line in [*lines, None]:
        if line is None or size > 200_000:
            if step:
                chars, starts = encode(step)
                scores.append(model.score(chars, starts))
                lengths.append(np.diff(np.append(starts, len(chars))))
                shares.append(_shares(chars, starts))
            step, size = [], 0
        if line is not None:
            step.append(line)
            size += len(line)
    score, length = np.concatenate(scores).astype(np.float64), np.maximum(np.concatenate(lengths), 1)
    letters = np.concatenate(shares)
    owner = np.array(owner)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            out.append((None, 0.0, True, []))
            continue
        rows = score[a:b]
        best = int(rows.sum(0).argmax())
        # The document's language is that of most of its text, line by line, where the sum is led by one odd line.
        own = rows.argmax(1)
        gain = rows.max(1) - rows[:, best]
        other = (gain > MARGIN) & (gain / length[a:b] > MARGIN_PER_CHAR)
        lang = np.where(other, own, best)
        soft = np.exp(model.temper * (rows - rows.max(1, keepdims=True)))
        sure = soft[np.arange(b - a), lang] / soft.sum(1)
        whole = rows.sum(0)
        post = np.exp(model.temper * (whole - whole.max()))
        script = letters[a:b].sum(0)
        rejected = model.reject is not None and bool(-whole[best] / max(length[a:b].sum() - (b - a), 1) > model.reject[best] or 2 * script[~model.scripts[best]].sum() > script.sum() or not script.sum())
        out.append((model.languages[best], float(post[best] / post.sum()), rejected, [(model.languages[j], float(s)) for j, s in zip(lang, sure)]))
    return out


def languages(docs: DataFrame, samples: DataFrame, key: str, text: str, label: str, sample_lang: str = "lang", sample_text: str = "text", most_samples: int = MOST_SAMPLES) -> DataFrame:
    """(key, seg, lang, confidence, rejected, mixed, named): per document one row with seg -1, per line one with its number.

    Lines are the text split at line breaks, blank ones skipped, numbered from 0. named is the language that the label
    names, '' for none. Empty and null texts, texts without letters and those that no model explains have one row with a null
    language; their lines, if they have any, come out with the language nearest to them. The models are fitted on at most
    most_samples labelled samples, the first by hash; every document is judged whole, in place.
    """
    rows = samples.filter(F.col(sample_lang).isNotNull() & F.col(sample_text).isNotNull()).select(label_language(F.col(sample_lang)).alias("l"), F.col(sample_text).alias("t")).orderBy(F.xxhash64("t"), "t").limit(most_samples).collect()
    labelled = [(r["l"], r["t"]) for r in rows if r["l"] and r["t"].strip()]
    if not labelled:
        raise ValueError("no labelled samples to train on")
    model = docs.sparkSession.sparkContext.broadcast(calibrated(labelled))
    schema = f"{key} long, seg int, lang string, confidence double, rejected boolean, mixed boolean, named string"

    def scan(batches):
        for batch in batches:
            keys, texts, named = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for k, name, (lang, sure, rejected, lines) in zip(keys, named, judge(model.value, texts)):
                mixed = len({x for x, _ in lines}) > 1
                out.append((k, -1, None if rejected and not mixed else lang, sure, rejected, mixed, name))
                out += [(k, i, x, s, rejected, mixed, name) for i, (x, s) in enumerate(lines)]
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.string()))], names=[key, "seg", "lang", "confidence", "rejected", "mixed", "named"])

    return spread(docs.select(F.col(key).cast("long"), text, label_language(F.col(label)).alias("named"))).mapInArrow(scan, schema)
