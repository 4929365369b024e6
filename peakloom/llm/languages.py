"""Languages of documents and of their stretches, by hierarchical discrimination.

A linear support vector machine tells the family of a passage, then one-versus-one machines tell the closely related
languages of that family apart. Features are hashed character n-grams. All machines are trained here on a bounded sample of
the labelled documents; labels that the first round of machines contradicts are left out of the second.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.text import mend

FAMILIES = {"germanic": ("de", "en", "nl"), "romance": ("es", "fr", "it", "pt"), "slavic": ("ru",), "east_asian": ("ja", "zh")}
LANGUAGES = tuple(sorted(x for f in FAMILIES.values() for x in f))
#: Names of languages in labels: two- and three-letter codes and English names (fixed values).
NAMES = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish castilian", "it": "it ita italian",
    "pt": "pt por portuguese", "nl": "nl nld dut dutch flemish", "ru": "ru rus russian", "ja": "ja jpn japanese", "zh": "zh zho chi chinese mandarin",
}
#: Common words of each language, as first examples where labelled documents are few (fixed values).
COMMON = {
    "en": "the and of to in is was that for with which from were not this are by have but had we our before after into only",
    "de": "der die das und ist nicht ein eine mit für von auf dem den wurde haben sich auch nach bei wir aus zu war noch keine",
    "fr": "le la les des et est une dans pour que qui sur pas avec nous du au sont cette plus par été mais ne ce après avant",
    "es": "el la los las de y que en una para con por no se del al es como más pero fue su hemos todavía antes después",
    "it": "il lo la gli di e che è un una per non con del della nel sono più come ma questo dopo abbiamo dal alla anche prima",
    "pt": "o a os as de e que em um uma para com não do da no na por mais como foi mas ao são depois antes nós ainda seu",
    "nl": "de het een en van is niet met voor op dat zijn werd bij we naar te aan ook maar nog uit wij heeft deze hebben geen",
    "ru": "и в не на что с по как это из был мы для от после при так же но или его была которые чтобы",
    "ja": "の は を に が と で した ました ため この もの から です ない について また こと して では",
    "zh": "的 是 在 了 和 不 我们 这 有 与 为 中 对 并 从 请 上 之后 没有 因为 它们 一个 可以",
}
#: Documents in the sample at most, passages of a language at most, rounds over the passages.
SAMPLE_DOCUMENTS, SAMPLE_PASSAGES, EPOCHS = 20_000, 1000, 3
BITS = 16
#: Characters of a passage of the sample at most.
LONGEST = 2_000
#: Documents that are read together.
TOGETHER = 2_048
#: Characters that are scored at once of a long passage.
PART = 20_000
#: A passage has at least so many words (or characters, where words aren't divided).
LEAST_WORDS, LEAST_SIGNS = 4, 6
PIECE = 9

_ALIAS = {n: code for code, names in NAMES.items() for n in names.split()}
_CODED = re.compile(r"(?<![A-Za-z+\[(/-])[A-Za-z+\[(/-]*+\d[A-Za-z0-9.,:+\-\[\]()/]*|\[[^\[\]\s]{0,60}\][+-]?|\b[A-Z]{2}-(?=\s|$)")
#: Without any of these a text has no code.
_MAYBE_CODED = re.compile(r"[\d\[]|[A-Z]-")
_REMARK = re.compile(r"\([^()\n]{0,80}\)|（[^（）\n]{0,40}）|\[[^\[\]\n]{0,80}\]|“[^“”\n]{0,60}”|„[^„“\n]{0,60}“|«[^«»\n]{0,60}»|「[^「」\n]{0,30}」|\"[^\"\n]{0,60}\"")
_END = re.compile(r"(?<=[.!?;:])\s+|(?<=[。！？])|\n\s*\n|\n(?=[#>\[\d])")
_SIGN = r"぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
_WORD = re.compile(rf"[{_SIGN}]+|[^\W\d_{_SIGN}]+(?:['’][^\W\d_{_SIGN}]+)*")
_SIGNS = re.compile(rf"[{_SIGN}]")
_CYRILLIC = re.compile("[Ѐ-ԯ]")


def label_languages(label: str | None) -> frozenset:
    """Languages that a label names: codes or English names, with or without region, one or several; other words name none."""
    if not label:
        return frozenset()
    out = set()
    for part in re.split(r"[,;/+|&\s]+|\band\b", label.strip().lower()):
        code = _ALIAS.get(re.split(r"[-_]", part)[0])
        if code:
            out.add(code)
    return frozenset(out)


def _kind(w: str) -> str:
    if w.isascii():
        return "latin"
    return "signs" if _SIGNS.match(w) else "cyrillic" if _CYRILLIC.search(w) else "latin"


def passages(text: str) -> list[tuple[str, str, list[str]]]:
    """(script, words joined by blanks, pieces) of the sentences of a text, and of their parts in another script.

    Numbers, formulas and codes, short remarks in brackets or quotes and single words in another script are left out. Long
    sentences also come in pieces of about PIECE words, as text without punctuation may run from one language into another.
    """
    text = _REMARK.sub(" ", unicodedata.normalize("NFC", mend(text)))
    out = []
    for sentence in _END.split(text):
        if not sentence:
            continue
        found = _WORD.findall((_CODED.sub(" ", sentence) if _MAYBE_CODED.search(sentence) else sentence).lower())
        runs: dict[str, list[str]] = {}
        if sentence.isascii():
            if found:
                runs["latin"] = found
        else:
            for w in found:
                runs.setdefault(_kind(w), []).append(w)
        main = max(runs, key=lambda k: len("".join(runs[k])) * (3 if k == "signs" else 1), default=None)
        for kind, ws in runs.items():
            if kind == "signs":
                if len("".join(ws)) >= LEAST_SIGNS:
                    out.append((kind, "".join(ws), []))
            elif len(ws) >= (LEAST_WORDS if kind == main else 2 * LEAST_WORDS) and sum(map(len, ws)) >= 12:
                n = len(ws) // PIECE
                out.append((kind, " ".join(ws), [" ".join(ws[i * len(ws) // n : (i + 1) * len(ws) // n]) for i in range(n)] if n > 1 else []))
    return out


def _codes(texts: list[str]) -> np.ndarray:
    """The characters of all texts on end, each between blanks and after a 0 but for the first."""
    return np.frombuffer("\0".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), "<u4").astype("u8") if texts else np.zeros(0, "u8")


def _slots(codes: np.ndarray):
    """(n, slots, bad) of the n-grams from each place on, n from 1 to 4; bad ones cross two texts."""
    h, bad = np.zeros(len(codes), "u8"), np.zeros(len(codes), bool)
    for n in range(1, 5):
        if len(codes) < n:
            return
        h = h[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :]
        bad = bad[: len(codes) - n + 1] | (codes[n - 1 :] == 0)
        mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        yield n, ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype("i4"), bad


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, starts): hashed character 1- to 4-grams of all texts on end, words with the blanks around them."""
    codes = _codes(texts)
    ends = np.flatnonzero(codes == 0)
    text_of = np.searchsorted(ends, np.arange(len(codes)))
    slots, owner = [], []
    for _, slot, bad in _slots(codes):
        slots.append(slot[~bad])
        owner.append(text_of[: len(slot)][~bad])
    slot, own = (np.concatenate(slots), np.concatenate(owner)) if slots else (np.zeros(0, "i4"), np.zeros(0, "i8"))
    order = np.argsort(own, kind="stable")
    return slot[order], np.searchsorted(own[order], np.arange(len(texts) + 1))


def _segment_sums(texts: list[str], segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]], table: np.ndarray) -> list[np.ndarray]:
    """Of each list of segments (text, begin, end), each between blanks: the sums of their n-grams' rows by the root of the n-grams' number.

    Segments of a list are in order, and at least a blank apart. Each n-gram is looked up once for all lists.
    """
    size = np.array([len(t) + 3 for t in texts], "i8")
    base = np.cumsum(size) - size
    spans = [(base[of] + begin, base[of] + end + 2, np.zeros((len(of), table.shape[1])), np.zeros(len(of))) for of, begin, end in segments]
    for n, slot, _ in _slots(_codes(texts)):
        rows = np.empty((len(slot) + 1, table.shape[1]), table.dtype)
        np.take(table, slot, axis=0, out=rows[:-1], mode="clip")
        rows[-1] = 0
        for lo, last, sums, count in spans:
            hi = np.maximum(last - n + 1, lo)
            if n == 1:  # the blank after a segment is the blank before the next
                sums += rows[hi - 1]
                hi = hi - 1
                count += 1
            count += hi - lo
            # from each segment's first n-gram up to its end, and from there up to the next segment
            got = np.add.reduceat(rows, np.stack([lo, hi], 1).ravel(), axis=0)[::2]
            got[hi <= lo] = 0
            sums += got
    return [sums / np.sqrt(np.maximum(count, 1))[:, None] for _, _, sums, count in spans]


def _chunks(sizes: list[int], most: int):
    """Ranges of consecutive entries of about ``most`` together."""
    lo = 0
    while lo < len(sizes):
        hi, total = lo, 0
        while hi < len(sizes) and (hi == lo or total + sizes[hi] <= most):
            total += sizes[hi]
            hi += 1
        yield lo, hi
        lo = hi


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int) -> np.ndarray:
    """Weights (slots x classes) of linear machines with the hinge loss, by averaged stochastic descent; y is +1 or -1."""
    rng = np.random.default_rng(seed)
    one = y.shape[1] == 1
    shape = (1 << BITS,) if one else (1 << BITS, y.shape[1])
    w, total, sides = np.zeros(shape, "f4"), np.zeros(shape, "f4"), y[:, 0] if one else y
    step = 0
    for epoch in range(EPOCHS):
        rate = np.float32(1.0 / (1 + epoch))
        for i in rng.permutation(len(rows)):
            slot, x = rows[i]
            # half of the n-grams are left out each time, lest a name that is frequent in one language decide alone
            kept = rng.random(len(slot)) < 0.5
            slot, x = slot[kept], x[kept] * 2
            wrong = (x @ w[slot]) * sides[i] < 1
            if wrong if one else wrong.any():
                change = rate * x * sides[i] if one else rate * x[:, None] * (sides[i] * wrong)[None, :].astype("f4")
                w[slot] += change
                total[slot] += step * change
            step += 1
    w, total = w.reshape(len(w), -1), total.reshape(len(w), -1)
    w -= total / max(1, step)
    most = np.quantile(np.abs(w[np.any(w != 0, axis=1)]), 0.98, axis=0)
    return np.clip(w, -most, most).astype("f4")


#: The families that a script may have.
ALLOWED = {"latin": ("germanic", "romance"), "cyrillic": ("slavic",), "signs": ("east_asian",)}


class Model:
    """The machines: one for each family, one for each two languages of a family."""

    def __init__(self, sample: list[tuple[str, str]], seed: int = 1):
        """sample: (passage, language)."""
        self.families = [f for f in FAMILIES]
        self.pairs = [(a, b) for f in FAMILIES.values() for a, b in combinations(f, 2)]
        slots, starts = features([t for t, _ in sample])
        rows = []
        for i in range(len(sample)):
            slot, n = np.unique(slots[starts[i] : starts[i + 1]], return_counts=True)
            rows.append((slot, (np.sqrt(n) / np.sqrt(max(1, n.sum()))).astype("f4")))
        lang = np.array([x for _, x in sample])
        fam_of = {x: f for f, xs in FAMILIES.items() for x in xs}
        fam = np.array([fam_of[x] for x in lang])
        parts = [_svm(rows, np.stack([np.where(fam == f, 1.0, -1.0) for f in self.families], 1).astype("f4"), seed)]
        for a, b in self.pairs:
            use = np.flatnonzero((lang == a) | (lang == b))
            parts.append(_svm([rows[i] for i in use], np.where(lang[use] == a, 1.0, -1.0)[:, None].astype("f4"), seed))
        self.weights = np.concatenate(parts, axis=1)
        self._tables: dict = {}

    def scores(self, texts: list[str], cols: np.ndarray) -> np.ndarray:
        """Margins of the machines ``cols`` (texts x machines) for texts of any length, taken in parts whose sums are added up."""
        out = np.zeros((len(texts), len(cols)))
        table = self._table(cols)
        for i, t in enumerate(texts):
            count = 0
            for at in range(0, max(1, len(t)), PART):
                slots, _ = features([t[at : at + PART]])
                out[i] += table[slots].sum(0)
                count += len(slots)
            out[i] /= np.sqrt(max(1, count))
        return out

    def _table(self, cols: np.ndarray) -> np.ndarray:
        """Weights of some machines, side by side."""
        key = tuple(cols)
        if key not in self._tables:
            self._tables[key] = np.ascontiguousarray(self.weights[:, cols])
        return self._tables[key]

    def __getstate__(self):
        return self.__dict__ | {"_tables": {}}

    def part_scores(self, sentences: list[tuple[str, list[str]]], cols: np.ndarray, chunk: int = 150_000) -> np.ndarray:
        """Margins of each sentence and, after it, of each of its pieces. N-grams of a sentence are looked up once and added up for both."""
        out = np.zeros((sum(1 + len(ps) for _, ps in sentences), len(cols)))
        first = np.concatenate([[0], np.cumsum([1 + len(ps) for _, ps in sentences])])
        long = [i for i, (t, _) in enumerate(sentences) if len(t) > PART]
        for i in long:
            out[first[i] : first[i + 1]] = self.scores([sentences[i][0], *sentences[i][1]], cols)
        rest = [i for i, (t, _) in enumerate(sentences) if len(t) <= PART]
        table = self._table(cols)
        for lo, hi in _chunks([len(sentences[i][0]) for i in rest], chunk):
            own = rest[lo:hi]
            texts = [sentences[i][0] for i in own]
            size = [np.array([len(p) for p in sentences[i][1]], "i8") for i in own]
            of = np.repeat(np.arange(len(own)), [len(x) for x in size])
            segments = [(np.arange(len(own)), np.zeros(len(own), "i8"), np.array([len(t) for t in texts]))]
            if len(of):  # pieces follow each other, a blank apart
                begin = np.concatenate([np.cumsum(x + 1) - x - 1 for x in size])
                segments.append((of, begin, begin + np.concatenate(size)))
            got = _segment_sums(texts, segments, table)
            out[first[own]] = got[0]
            if len(of):
                out[first[np.array(own)[of]] + 1 + np.concatenate([np.arange(len(x)) for x in size])] = got[1]
        return out

    def classify(self, texts: list[str], kinds: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, confidence) of each passage. The script limits the families."""
        return self.classify_parts([(k, t, []) for k, t in zip(kinds, texts)])

    def columns(self, kind: str) -> np.ndarray:
        """The machines that a script needs: those of its families and of their pairs."""
        names = ALLOWED[kind]
        members = {x for f in names for x in FAMILIES[f]}
        return np.array([i for i, f in enumerate(self.families) if f in names] + [len(self.families) + k for k, (a, _) in enumerate(self.pairs) if a in members])

    def classify_parts(self, sentences: list[tuple[str, str, list[str]]]) -> tuple[list[str], np.ndarray]:
        """(language, confidence) of each (script, sentence, pieces) and, after it, of its pieces. The script limits the families."""
        kinds = [k for k, _, ps in sentences for _ in range(1 + len(ps))]
        s = np.zeros((len(kinds), self.weights.shape[1]))
        first = np.concatenate([[0], np.cumsum([1 + len(ps) for _, _, ps in sentences])]).astype("i8")
        for kind in ALLOWED:
            own = [i for i, x in enumerate(sentences) if x[0] == kind]
            if own:
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
                cols = self.columns(kind)
                s[rows[:, None], cols] = self.part_scores([sentences[i][1:] for i in own], cols)
        mask = np.array([[f in ALLOWED[k] for f in self.families] for k in kinds]) if kinds else np.zeros((0, len(self.families)), bool)
        fam = np.where(mask, s[:, : len(self.families)], -1e9)
        best = fam.argmax(1) if len(kinds) else np.zeros(0, int)
        langs, sure = [""] * len(kinds), np.zeros(len(kinds))
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            if not len(rows):
                continue
            members = FAMILIES[name]
            wins = np.zeros((len(rows), len(members)))
            margin = np.zeros((len(rows), len(members)))
            for k, (a, b) in enumerate(self.pairs):
                if a in members:
                    m = s[rows, len(self.families) + k]
                    ia, ib = members.index(a), members.index(b)
                    wins[:, ia] += m > 0
                    wins[:, ib] += m <= 0
                    margin[:, ia] += m
                    margin[:, ib] -= m
            order = wins + 1e-3 * np.tanh(margin)
            top = order.argmax(1)
            rest = np.sort(np.where(mask[rows], s[rows][:, : len(self.families)], -3.0), axis=1)
            gap = rest[:, -1] - rest[:, -2]
            if len(members) > 1:
                worst = np.full(len(rows), np.inf)
                for k, (a, b) in enumerate(self.pairs):
                    if a in members:
                        m = s[rows, len(self.families) + k]
                        worst = np.where(top == members.index(a), np.minimum(worst, m), worst)
                        worst = np.where(top == members.index(b), np.minimum(worst, -m), worst)
                gap = np.minimum(gap, 2 * worst)
            conf = 1 / (1 + np.exp(-2.0 * np.clip(gap, -20, 20)))
            for r, t, c in zip(rows, top, conf):
                langs[r], sure[r] = members[t], c
        return langs, sure


def train(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, sample_passages: int = SAMPLE_PASSAGES) -> Model:
    """Machines from a bounded sample: the first documents in order of a hash whose label names one language.

    At most ``sample_documents`` documents and ``sample_passages`` passages of a language, none longer than LONGEST, are used,
    whatever the input; they are cut where the documents are, so the driver gets no more than four times as many passages.
    """
    fits = {"latin": ("de", "en", "es", "fr", "it", "nl", "pt"), "cyrillic": ("ru",), "signs": ("ja", "zh")}

    def cut_up(batches):
        for pdf in batches:
            rows = []
            for place, text, label in zip(pdf.place, pdf.text, pdf.lang):
                names = label_languages(label)
                if len(names) == 1:
                    (x,) = names
                    found = [(kind, q) for kind, p, pieces in passages(text) if x in fits[kind] for q in [p, *pieces] if len(q) <= LONGEST]
                    rows += [(place, i, x, kind, q) for i, (kind, q) in enumerate(found[: 4 * sample_passages])]
            yield pd.DataFrame(rows, columns=["place", "i", "lang", "kind", "passage"])

    labelled = documents.select(F.xxhash64(F.col("doc_id"), F.lit(11)).alias("place"), "doc_id", "text", "lang").where("text is not null and lang is not null")
    # hashes are spread evenly, so half as many again as are wanted lie below this one, and no task hands on more than its share
    share = min(1.0, 1.5 * sample_documents / max(1, labelled.select("doc_id").count()))
    below = labelled if share == 1.0 else labelled.where(F.col("place") < int(share * 2**64) - 2**63)
    sample = below.orderBy("place", "doc_id").limit(sample_documents).select("place", "text", "lang")
    cut_ = sample.mapInPandas(cut_up, "place bigint, i int, lang string, kind string, passage string")
    first_ones = Window.partitionBy("lang").orderBy("place", "i", "passage")
    rows = cut_.withColumn("r", F.row_number().over(first_ones)).where(F.col("r") <= 4 * sample_passages).orderBy("lang", "r").collect()
    by: dict[str, list[tuple[str, str]]] = {x: [] for x in LANGUAGES}
    for r in rows:
        by[r.lang].append((r.kind, r.passage))
    rng = np.random.default_rng(3)
    fixed = []
    for x, ws in COMMON.items():
        w = np.array(ws.split())
        fixed += [("".join(p) if x in ("ja", "zh") else " ".join(p), x) for p in (rng.choice(w, 8) for _ in range(30))]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))

    def draw(of: dict) -> list[tuple[str, str]]:
        out = list(fixed)
        for x, ps in of.items():
            some = [ps[i] for i in rng.permutation(len(ps))[:sample_passages]]
            out += [(p, x) for _, p in some]
            out += [(plain(p), x) for k, p in some[::4] if k == "latin"]
        return out

    first = Model(draw(by))
    clean: dict[str, list] = {}
    for x, ps in by.items():
        langs, _ = first.classify([p for _, p in ps], [k for k, _ in ps])
        clean[x] = [p for p, got in zip(ps, langs) if got == x]
    return Model(draw(clean))


#: A sentence below DOUBT takes the main language of its text; a piece at or above CERTAIN may differ from its sentence.
DOUBT, CERTAIN, LEAST_PIECE = 0.9, 0.98, 25
#: Latin passages with fewer letters don't bring in a language of their own; they are remarks, or mostly names.
SHORT = 45


def _script_of(lang: str) -> str:
    return "cyrillic" if lang == "ru" else "signs" if lang in ("ja", "zh") else "latin"


def stretches(model: Model, texts: list[str | None]) -> list[list[tuple[str, float, str]]]:
    """For each text, its stretches in one language: (language, confidence, words)."""
    # equal texts are cut once, equal sentences scored once
    known: dict[str, list] = {t: passages(t) for t in set(texts) if t}
    cut = [known.get(t, []) if t else [] for t in texts]
    sentences = list({(k, p): (k, p, pieces) for ps in known.values() for k, p, pieces in ps}.values())
    langs, sure = model.classify_parts(sentences)
    place = dict(zip([(k, p) for k, p, _ in sentences], itertools.accumulate((1 + len(pieces) for _, _, pieces in sentences), initial=0)))
    out = []
    for ps in cut:
        parts: list[tuple[str, float, str]] = []
        for k, p, pieces in ps:
            at = place[k, p]
            x, c = langs[at], float(sure[at])
            at += 1
            if not pieces:
                parts.append((x, c, p))
                continue
            own = [(langs[at + i], float(sure[at + i]), q) for i, q in enumerate(pieces)]
            if all(y == x or d < CERTAIN or len(q) < LEAST_PIECE for y, d, q in own):
                parts.append((x, c, p))
            else:
                for y, d, q in own:
                    parts.append((y, d, q) if y == x or (d >= CERTAIN and len(q) >= LEAST_PIECE) else (x, min(c, 1 - d), q))
        weight: dict[str, float] = {}
        vague = [c < DOUBT or (len(p) < SHORT and _script_of(x) == "latin") for x, c, p in parts]
        for (x, c, p), v in zip(parts, vague):
            if not v:
                weight[x] = weight.get(x, 0.0) + len(p)
        merged: list[list] = []
        for (x, c, p), v in zip(parts, vague):
            if v and x not in weight and (same := [y for y in weight if _script_of(y) == _script_of(x)]):
                x = max(same, key=lambda y: (weight[y], y))
            if merged and merged[-1][0] == x:
                merged[-1][1].append((c, len(p)))
                merged[-1][2].append(p)
            else:
                merged.append([x, [(c, len(p))], [p]])
        out.append([(x, float(sum(c * n for c, n in cn) / sum(n for _, n in cn)), " ".join(q)) for x, cn, q in merged])
    return out


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, part, lang, confidence, words): each stretch of a document in one language, in order.

    Null and empty texts and those without a sentence have no row. Whole texts are read; remarks, names and formulas count
    for nothing. The model is trained on a bounded sample of the same documents where none is given.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or train(documents))
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[lo : lo + TOGETHER]
                rows = [(d, i, *s) for d, ss in zip(part.doc_id.tolist(), stretches(shared.value, part.text.tolist())) for i, s in enumerate(ss)]
                yield pd.DataFrame(rows, columns=["doc_id", "part", "lang", "confidence", "words"])

    return documents.select("doc_id", "text").where("text is not null").mapInPandas(run, f"doc_id {kind}, part int, lang string, confidence double, words string")


def document_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang, confidence, label, right): the languages of each document, and whether its label names exactly these."""
    shared = documents.sparkSession.sparkContext.broadcast(model or train(documents))
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[lo : lo + TOGETHER]
                rows = []
                for d, label, ss in zip(part.doc_id.tolist(), part.lang.tolist(), stretches(shared.value, part.text.tolist())):
                    by: dict[str, list] = {}
                    for x, c, p in ss:
                        by.setdefault(x, []).append((c, len(p)))
                    right = label_languages(label) == frozenset(by)
                    rows += [(d, x, sum(c * n for c, n in cn) / sum(n for _, n in cn), label, right) for x, cn in by.items()]
                yield pd.DataFrame(rows, columns=["doc_id", "lang", "confidence", "label", "right"])

    return documents.select("doc_id", "text", "lang").where("text is not null").mapInPandas(run, f"doc_id {kind}, lang string, confidence double, label string, right boolean")
