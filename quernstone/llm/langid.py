"""Language of documents and of segments in mixed ones: a linear-chain conditional random field over words.

A word's emission is the sum of learned weights of its hashed features (lexicon, affixes, character trigrams, the word
itself); the transitions between the languages of neighbouring words are learned with them. Forward-backward gives every
word's distribution, sentences take the language with the greatest sum, and adjacent sentences of one language make a segment. A
stretch of words inside a sentence that is surely in another language makes a segment of its own, which counts no full sentence.

The field is fitted here, on at most FIT_DOCUMENTS documents (those with the least hash of their id, a documented bound).
Their words are labelled without hand-made labels: a sentence gets a language if its function words point to one clearly.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import least_hashed, stored

LANGS = ("en", "de", "fr", "es", "pt", "it", "nl", "zh")
FIT_DOCUMENTS = 600
#: Documents with more characters don't teach; a longer run of words teaches as several.
FIT_CHARACTERS, FIT_RUN = 50_000, 200
BUCKETS = 1 << 15

#: Function words of each language.
FUNCTION_WORDS = {
    "en": "the a an and or of to in on at by for with from is are was were be been it its this that these those as but not no if when which who we you they our your their has have had will would can could should there into over under after before between than then only each every all any some more most other such where because while until without about both how what why through during against",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist sind war waren wird werden wurde hat haben im in am an auf aus bei mit nach seit von vom zu zum zur für über unter durch ohne gegen um als wenn weil dass ob wie wo wer was sich es er sie wir ihr ich auch noch nur schon sehr jede jeden jeder jedes alle nach vor zwischen während bis damit obwohl sobald",
    "fr": "le la les l un une des du de d et ou mais ne pas est sont était a ont au aux en dans sur sous avec sans pour par entre avant après pendant depuis que qui quoi dont où ce cette ces cet il elle ils elles nous vous je on se sa son ses leur leurs chaque tous toutes tout plus très aussi car si comme afin bien puis lors",
    "es": "el la los las un una unos unas y o pero no es son era fue ha han del de al a en con sin por para entre antes después durante desde hasta sobre bajo que quien cual como cuando donde porque si se su sus este esta estos estas ese esa lo le les nos yo ellos cada todo todos toda todas más muy también aunque mientras según tras",
    "pt": "o a os as um uma uns umas e ou mas não é são era foi tem do da dos das de ao à aos às em no na nos nas num numa com sem por pelo pela para entre antes depois durante desde até sobre sob que quem qual como quando onde porque se seu sua seus suas este esta esse essa isso ele ela eles nós cada todo todos toda todas mais muito também embora enquanto segundo após",
    "it": "il lo la i gli le l un uno una e o ma non è sono era ha hanno del dello della dei degli delle di al allo alla ai agli alle a da dal dalla dai in nel nella nei nelle con senza per tra fra su sul sulla sui prima dopo durante che chi cui come quando dove perché se si suo sua suoi loro questo questa questi ogni tutto tutti tutte più molto anche poi così fino secondo",
    "nl": "de het een en of maar niet geen is zijn was waren wordt worden werd heeft hebben in op aan bij met naar van voor door over onder tussen na sinds tot uit zonder tegen om als wanneer omdat dat die dit deze wie wat waar hoe er hij zij ze wij we jij ik ook nog alleen al heel elke elk alle meer wel dan terwijl zodat voordat volgens",
    "zh": "",
}
#: Names and three-letter codes of the languages, lower case.
NAMES = {
    "en": "english eng anglais englisch inglés ingles", "de": "german deu ger deutsch allemand alemán", "fr": "french fra fre français francais französisch francés",
    "es": "spanish spa español espanol espagnol castilian", "pt": "portuguese por português portugues", "it": "italian ita italiano",
    "nl": "dutch nld dut nederlands flemish", "zh": "chinese zho chi 中文 mandarin cmn",
}
DECLARED = {name: lang for lang, names in NAMES.items() for name in [lang, *names.split()]}
#: Shortenings after which a full stop ends no sentence.
SHORT = frozenset("prof dr med ctr inst intl fdn inc ltd co corp dipl ing univ dept dep st mr mrs ms no nr vs etc bzw ca sr sra dra dott ir jr gmbh".split())

HAN = "㐀-䶿一-鿿"
TOKEN = re.compile(rf"[{HAN}]+|[^\W\d_{HAN}]+")
FENCE = re.compile(r"^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\Z)", re.S | re.M)
NOT_PROSE = re.compile(r"[ \t]*(?:#{1,6}\s|\||\+[-=+]+|[{\[]\s*[\"{\[]|>?\s*https?://\S+\s*$)")
#: A line whose letters, marks within words and blanks make up less than this share is data, not prose.
LETTERS = 0.7
PROSE_CHARACTER = re.compile(r"[^\W\d_]|[ ']")
PADDING = re.compile(r"\s+")
STOP = re.compile(rf"[.!?]+[\"'”»)\]]*(?=\s+[^a-zà-ÿ\s])|[。！？]+[”』」]*")


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


LEXICON: dict[str, list[int]] = {}
for _n, _lang in enumerate(LANGS):
    for _w in {x for w in FUNCTION_WORDS[_lang].split() for x in (w, _plain(w))}:
        LEXICON.setdefault(_w, []).append(_n)


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word; the first len(LANGS) + 1 buckets are the lexicons and the Han script."""
    if "㐀" <= word[0] <= "鿿":
        return [len(LANGS)]
    out = list(LEXICON.get(word, ()))
    padded = f"^{word}$"
    keys = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3, 4)] + [f"w{word}"] + [f"g{padded[i : i + 3]}" for i in range(len(padded) - 2)]
    first = len(LANGS) + 1
    return out + [first + xxhash.xxh32_intdigest(k) % (BUCKETS - first) for k in keys]


def sentences(line: str) -> list[tuple[int, int]]:
    """Spans of a line's sentences."""
    out, at = [], 0
    for m in STOP.finditer(line):
        before = re.search(r"(\w+)$", line[max(at, m.start() - 12) : m.start()])
        if m.group()[0] == "." and before and (len(before[1]) == 1 or before[1].lower() in SHORT):
            continue
        out.append((at, m.end()))
        at = m.end()
    if line[at:].strip():
        out.append((at, len(line)))
    return out


def _readable(line: str) -> bool:
    """Letters make up most of the line. A run of blanks, tabs or CR counts as one space, so that padding weighs nothing."""
    line = PADDING.sub(" ", line.strip())
    return len(PROSE_CHARACTER.findall(line)) >= LETTERS * len(line)


#: What is longer than any word (addresses, hashes, encoded data) is blanked out before the line is judged.
NO_WORD = re.compile(rf"[^\s{HAN}，。！？；：、]{{61,}}")


def prose(text: str) -> list[tuple[int, str]]:
    """(position, line) of the lines that are prose: no fenced code, headings, table rows or bare addresses."""
    gone = [m.span() for m in FENCE.finditer(text)] if "```" in text or "~~~" in text else []
    out, at = [], 0
    for line in text.split("\n"):
        size = len(line) + 1
        if line and not line.isspace() and not NOT_PROSE.match(line) and not any(a <= at < b for a, b in gone):
            if size > 61:
                line = NO_WORD.sub(lambda m: " " * len(m[0]), line)
            if not line.isspace() and _readable(line):
                out.append((at, line))
        at += size
    return out


#: A capitalised word that doesn't begin its sentence is likely a name: its evidence counts this much.
NAME = 0.25


def parse(text: str) -> list[tuple[list[str], list[tuple[int, int, int, int]], list[float]]]:
    """Per prose line: its lower-cased words, its sentences as (first word, one past the last, start, end), the words' weights.

    A sentence of capitalised words alone, none of them a function word, is a list of names and left out.
    """
    out = []
    for at, line in prose(text):
        words: list[str] = []
        weights: list[float] = []
        spans = []
        for a, b in sentences(line):
            got = TOKEN.findall(line[a:b])
            low = [w.lower() for w in got]
            han = any("㐀" <= w[0] <= "鿿" for w in got)
            small = sum(w[0].islower() for w in got)
            if not small and not han and not all(map(str.isupper, got)) and not any(w in LEXICON for w in low):
                continue
            spans.append((len(words), len(words) + len(got), at + a, at + b))
            words += low
            cased = small >= 2 or han
            weights += [1 + len(w) / 2 if "㐀" <= w[0] <= "鿿" else NAME if cased and k and w[0].isupper() else 1.0 for k, w in enumerate(got)]
        if words:
            out.append((words, spans, weights))
    return out


class Model:
    """Feature weights and transitions, with the emissions of words seen so far."""

    REMEMBERED = 300_000

    def __init__(self) -> None:
        self.weights = np.zeros((BUCKETS, len(LANGS)), np.float32)
        for n in range(len(LANGS)):
            self.weights[n, n] = 2.0
        self.weights[len(LANGS), LANGS.index("zh")] = 6.0
        self.transitions = np.where(np.eye(len(LANGS), dtype=bool), 2.0, -2.0).astype(np.float32)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGS)), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        """One row of emissions per word, from a table of the words seen so far."""
        rows = self.rows
        if len(rows) + len(words) > self.REMEMBERED:
            rows.clear()
        for w in words:
            if w not in rows:
                n = rows[w] = len(rows)
                if n == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[n] = self.weights[features(w)].sum(0)
        return self.table[[rows[w] for w in words]]

    CELLS = 60_000

    def marginals(self, emissions: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Forward-backward over sequences that lie one after another in `emissions`; those of like length go together, as
        many as keep the padded batch within CELLS words."""
        out = np.empty_like(emissions)
        starts = np.cumsum([0, *lengths])
        order = sorted(range(len(lengths)), key=lengths.__getitem__)
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * lengths[order[end]] <= self.CELLS:
                end += 1
            part = order[at:end]
            probs = forward_backward([emissions[starts[i] : starts[i + 1]] for i in part], self.transitions, False)[0]
            for row, i in enumerate(part):
                out[starts[i] : starts[i + 1]] = probs[row, : lengths[i]]
            at = end
        return out


def forward_backward(sequences: list[np.ndarray], transitions: np.ndarray, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (sequence, step, language), zero beyond a sequence's end, and, if `count`, expected transition counts."""
    n, longest, k = len(sequences), max(map(len, sequences)), transitions.shape[0]
    lengths = np.array([len(s) for s in sequences])
    emit = np.ones((n, longest, k), np.float32)
    flat = np.concatenate(sequences)
    emit[np.arange(longest)[None, :] < lengths[:, None]] = np.exp(flat - flat.max(1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    forward, backward = np.empty_like(emit), np.ones_like(emit)
    alpha = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    forward[:, 0] = alpha
    for t in range(1, longest):
        alpha = (alpha @ move) * emit[:, t] + 1e-30
        alpha /= alpha.sum(1, keepdims=True)
        forward[:, t] = alpha
    beta = np.ones((n, k), np.float32)
    for t in range(longest - 1, 0, -1):
        beta = np.where((t < lengths)[:, None], (beta * emit[:, t]) @ move.T, 1.0)
        beta /= beta.sum(1, keepdims=True)
        backward[:, t - 1] = beta
    probs = forward * backward
    probs /= probs.sum(2, keepdims=True)
    inside = np.arange(longest)[None, :] < lengths[:, None]
    probs *= inside[:, :, None]
    expected = np.zeros((k, k))
    for t in range(1, longest if count else 1):
        pair = forward[:, t - 1, :, None] * move[None] * (emit[:, t] * backward[:, t])[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True) + 1e-30
        expected += pair[inside[:, t]].sum(0)
    return probs, expected


def weak_label(words: list[str]) -> int:
    """Language that the function words point to clearly, else -1."""
    if not words:
        return -1
    votes = np.zeros(len(LANGS))
    for w in words:
        if "㐀" <= w[0] <= "鿿":
            votes[LANGS.index("zh")] += 1 + len(w) / 4
        for n in LEXICON.get(w, ()):
            votes[n] += 1 / len(LEXICON[w])
    best = int(votes.argmax())
    return best if votes[best] >= 2 and votes[best] >= 1.5 * np.sort(votes)[-2] else -1


def fit(texts: list[str], rounds: int = 30, rate: float = 0.3) -> Model:
    """Maximum likelihood with a small ridge, by Adagrad over all sequences at once. No usable text leaves the prior weights."""
    model = Model()
    seqs, golds = [], []
    for n, text in enumerate(texts):
        for words, spans, _ in parse(text):
            if n % 2:  # lost accents are as frequent in the fit as whole ones
                words = [_plain(w) for w in words]
            run: list[str] = []
            gold: list[int] = []
            for a, b, _, _ in [*spans, (0, 0, 0, 0)]:
                label = weak_label(words[a:b])
                if label >= 0:
                    run += words[a:b]
                    gold += [label] * (b - a)
                elif run:
                    for k in range(0, len(run), FIT_RUN):
                        seqs.append(run[k : k + FIT_RUN])
                        golds.append(np.array(gold[k : k + FIT_RUN]))
                    run, gold = [], []
    if not seqs:
        return model
    index = {w: i for i, w in enumerate(dict.fromkeys(w for s in seqs for w in s))}
    lists = [features(w) for w in index]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feats = np.concatenate(lists)
    ids = [np.array([index[w] for w in s]) for s in seqs]
    order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
    total = sum(map(len, ids))
    gold_moves = np.zeros((len(LANGS),) * 2)
    gold_emit = np.zeros((len(index), len(LANGS)))
    for i, y in zip(ids, golds):
        np.add.at(gold_emit, (i, y), 1)
        np.add.at(gold_moves, (y[:-1], y[1:]), 1)
    start_w, start_t = model.weights.copy(), model.transitions.copy()
    seen_w, seen_t = np.full_like(model.weights, 1e-8), np.full_like(model.transitions, 1e-8)
    for _ in range(rounds):
        table = np.zeros((len(index), len(LANGS)), np.float32)
        np.add.at(table, owner, model.weights[feats])
        got_emit, got_moves = np.zeros_like(gold_emit), np.zeros_like(gold_moves)
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            probs, moves = forward_backward([table[ids[i]] for i in part], model.transitions)
            got_moves += moves
            for row, i in enumerate(part):
                np.add.at(got_emit, ids[i], probs[row, : len(ids[i])])
        grad = np.zeros_like(model.weights)
        np.add.at(grad, feats, ((gold_emit - got_emit) / total)[owner].astype(np.float32))
        grad -= 1e-5 * (model.weights - start_w)
        move = ((gold_moves - got_moves) / total - 1e-4 * (model.transitions - start_t)).astype(np.float32)
        seen_w += grad**2
        seen_t += move**2
        model.weights += rate * grad / np.sqrt(seen_w)
        model.transitions += rate * move / np.sqrt(seen_t)
    return model


def fit_on(df: DataFrame, id_col: str, text_col: str, bound: int = FIT_DOCUMENTS) -> Model:
    """Fits on the `bound` texts, of at most FIT_CHARACTERS characters, whose ids have the least hash: the same documents however the
    table is partitioned. Fitted once for the same texts, then read from the shared folder."""
    usable = df.where(F.col(text_col).isNotNull() & (F.length(text_col) <= FIT_CHARACTERS)).select(id_col, text_col)
    texts = sorted(r[1] for r in least_hashed(usable, id_col, bound).collect())
    model = Model()
    model.weights, model.transitions = stored(df.sparkSession, "langid", texts, lambda: (lambda m: (m.weights, m.transitions))(fit(texts)))
    return model


SEGMENTS = "array<struct<start_pos:int,end_pos:int,lang:string,confidence:double,words:double,sentences:int>>"
#: Words of another language inside a sentence that make a segment, and the least probability of each.
SWITCH, SURE = 4, 0.9


def _switches(text: str, start: int, end: int, probs: np.ndarray, best: int) -> list[tuple[int, int, int, float, float]]:
    """(start, end, language, sum of probabilities, words) of the stretches of a sentence, which together cover it."""
    places = [m.span() for m in TOKEN.finditer(text[start:end])]
    which = np.where(probs.max(1) >= SURE, probs.argmax(1), best)
    edges = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True])
    runs = [[int(a), int(b), int(which[a]) if b - a >= SWITCH else best] for a, b in zip(edges, edges[1:])]
    merged = [runs[0]]
    for r in runs[1:]:
        if r[2] == merged[-1][2]:
            merged[-1][1] = r[1]
        else:
            merged.append(r)
    cuts = [start, *(start + places[a][0] for a, _, _ in merged[1:]), end]
    return [(cuts[k], cuts[k + 1], n, float(probs[a:b, n].sum()), float(b - a)) for k, (a, b, n) in enumerate(merged)]


def segments_of(texts: list[str | None], model: Model, min_words: int = 4) -> list[list[dict]]:
    """The segments of each text, by position."""
    parsed = [parse(t) if t else [] for t in texts]
    lines = [line for each in parsed for line in each]
    if not lines:
        return [[] for _ in texts]
    lengths = [len(words) for words, _, _ in lines]
    size = np.array([x for _, _, weights in lines for x in weights])
    flat = model.emissions([w for words, _, _ in lines for w in words]) * np.minimum(size, 1)[:, None]
    probs = model.marginals(flat.astype(np.float32), lengths)
    first = np.cumsum([0, *lengths])
    spans = np.array([(first[k] + a, first[k] + b, s, e) for k, (_, each, _) in enumerate(lines) for a, b, s, e in each if b > a], np.int64).reshape(-1, 4)
    record = np.repeat(np.arange(len(texts)), [sum(b > a for _, each, _ in x for a, b, _, _ in each) for x in parsed])
    begin, past = spans[:, 0], spans[:, 1]
    mass = np.add.reduceat(probs * size[:, None], begin, 0)
    best = mass.argmax(1)
    weight = np.add.reduceat(size, begin)
    sure = mass[np.arange(len(best)), best]
    other = (probs.argmax(1) != np.repeat(best, past - begin)) & (probs.max(1) >= SURE)
    mixed = np.add.reduceat(other, begin) >= SWITCH
    characters = np.array([len(w) for words, _, _ in lines for w in words])
    zh = LANGS.index("zh")
    full = (past - begin >= min_words) | (best == zh) & (np.add.reduceat(characters, begin) >= 5)
    out: list[list[list]] = [[] for _ in texts]
    for k in np.flatnonzero(full):
        a, b, s, e = spans[k].tolist()
        parts = [(s, e, int(best[k]), float(sure[k]), float(weight[k]))]
        if mixed[k]:
            parts = _switches(texts[record[k]], s, e, probs[a:b], int(best[k]))
        mine = out[record[k]]
        for s, e, n, p, w in parts:
            whole = int(n == best[k])
            if mine and mine[-1][2] == n:
                mine[-1][1] = e
                mine[-1][3] += p
                mine[-1][4] += w
                mine[-1][5] += whole
            else:
                mine.append([s, e, n, p, w, whole])
    return [[{"start_pos": s, "end_pos": e, "lang": LANGS[n], "confidence": round(p / w, 4), "words": w, "sentences": c} for s, e, n, p, w, c in each] for each in out]


def label_segments(df: DataFrame, id_col: str, text_col: str, model: Model, keep: tuple[str, ...] = (), min_words: int = 4) -> DataFrame:
    """(record_id, *keep, segments): segments of one language each, by position, with the mean probability of its words, their
    number (Han runs count by their length) and how many sentences are in that language.

    A sentence with fewer than min_words words (fewer than five Han characters) makes no segment of its own. Null, empty and
    blank texts, and those without prose, have no segments. The text itself is not passed on. Columns in keep are renamed
    keep_<name> where they clash with record_id, text or segments.
    """
    kept = [F.col(c).alias(f"keep_{c}" if c in ("record_id", "text", "segments") else c) for c in keep]
    source = df.select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).cast("string").alias("text"), *kept)
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.transitions))  # BUCKETS x 8 floats, 1 MB
    kind = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.float64()), ("sentences", pa.int32())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model()
        mine.weights, mine.transitions = shared.value
        for batch in it:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = segments_of(part.column(1).to_pylist(), mine, min_words)
                names = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + [pa.array(out, kind)], names=[*names, "segments"])

    fields = [f for f in source.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", segments {SEGMENTS}"
    return source.mapInArrow(batches, schema)


def main_language(segments: F.Column) -> F.Column:
    """struct<lang,confidence>: the language of most words, and how much of the text's words it surely holds; null without segments."""
    total = lambda keep: F.aggregate(F.filter(segments, keep), F.lit(0.0), lambda acc, s: acc + s["words"])
    weights = F.transform(F.array_distinct(F.transform(segments, lambda s: s["lang"])), lambda n: F.struct(total(lambda s: s["lang"] == n).alias("w"), n.alias("lang")))
    best = F.array_max(weights)["lang"]
    held = F.aggregate(F.filter(segments, lambda s: s["lang"] == best), F.lit(0.0), lambda acc, s: acc + s["words"] * s["confidence"])
    return F.when(F.size(segments) > 0, F.struct(best.alias("lang"), F.round(held / total(lambda s: F.lit(True)), 4).alias("confidence")))


def declared_language(metadata: F.Column) -> F.Column:
    """The language a metadata JSON declares, as one of LANGS; null where missing, unusable or another language."""
    label = F.lower(F.trim(F.get_json_object(metadata, "$.lang")))
    known = F.create_map(*[F.lit(x) for pair in DECLARED.items() for x in pair])
    return F.coalesce(known[label], known[F.regexp_extract(label, r"^([a-z]{2,3})[-_].*$", 1)])
