"""Abusive, hateful and sexual content: gradient-boosted trees over dense features, calibrated by isotonic regression.

A text is read once into words, marks and sentences; obfuscation (look-alike letters, invisible marks, stretched, spaced, dotted
and masked words) is undone word by word. Every sentence gets dense features: counts and densities of lexicons, distance of
harsh words to words that address a person or name a group, capitals, marks, rate of obfuscation, and the weight of words that
ratings single out. Trees judge every sentence - there is no gate before them and no hand-set margin - and a document has
the probability that isotonic regression gives to its worst sentence's margin.

The trees are fitted on the rated documents (at most FIT_ROWS, of at most FIT_CHARACTERS characters each) and on TAUGHT, a few sentences labelled by hand, which
count as one document each: with few ratings they lead, with many they hardly weigh. A rating doesn't say which sentence it
means; the one that the trees of the round before find worst is taken. Margins to calibrate on come from trees that haven't seen the document.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Bins, Trees, isotonic
from .sampling import least_hashed

CATEGORIES = ("abusive", "hateful", "sexual")
FIT_ROWS = 6_000
FIT_CHARACTERS = 20_000
FOLDS = 3

#: Words, without accents, of each kind in several languages.
LEXICONS = {
    "insult": "idiot idiots moron morons cretin cretins imbecile halfwit scumbag bastard loser losers dumbass asshole bitch jerk twat prick dickhead wanker dimwit nitwit numbskull fool clown pig trottel versager schwachkopf arschloch dummkopf vollidiot idioten mistkerl abruti connard conne debile ordure salaud imbecil imbeciles payaso idiota gilipollas cabron estupido cretino imbecille stronzo deficiente coglione otario babaca burro idioot klootzak sukkel mislukkeling eikel debiel 白痴 蠢货 废物 混蛋 笨蛋 傻瓜",
    "scorn": "useless worthless rotten disgusting brainless spineless pathetic stupid miserable filthy ugly dumb wertloser widerlicher dummer wertlose erbarmlicher nutzloser sale pauvre inutile stupide minable inutil miserable asqueroso patetico disgustoso nutteloze waardeloze walgelijke domme nojento",
    "dismiss": "shut vanish crawl lost die ashamed existing nobody klappe verschwinde verpiss ferme degage tais callate largate calla sparisci vattene zitto rot flikker verdwijn suma 滚 闭嘴",
    "threat": "break kill hurt beat smash punch bleed bury hunt stab strangle bones legs teeth neck regret pay umbringen schlagen brechen blut knochen tuer frapper casser regretteras matar romper golpear sangre huesos arrepentiras uccidere spezzare picchiare ammazzo pentirai quebrar bater sangue vermoorden slaan breken 杀 打断 弄死",
    "person": "you your yours youre u ur yourself du dich dir dein deine tu te ton ta tes toi vous votre ti tus usted eres sei tuo tua ti voce seu jij je jou jouw 你 您",
    "self": "i me my mine myself suis ich mein mich yo soy mi io sono mio eu sou ik ben mijn sorry",
    "group": "people peoples migrants immigrants believers families clan folk foreigners refugees women men jews muslims christians gypsies race tribe they them kind lot natives citizens country town city nation alle tous todos tutti auslander fluchtlinge etrangers extranjeros migranti vreemdelingen",
    "degrade": "vermin rats parasites parasite subhuman filth disease animals criminals scum breed breeding cages sterilised sterilized driven wiped exterminated deported gassed burned blood deserve ungeziefer untermenschen abschaum verschwinden recht raus parasiten hommes vermine meritent dehors parasitos escoria ratas echarlos merecen fuera parassiti feccia fuori ongedierte tuig eruit parasitas escumalha",
    "sexual": "sex sexy nude naked xxx porn porno horny moans moaning breasts panting explicit uncensored strips lover naughty orgasm penis vagina cock pussy tits fuck fucking blowjob erotic thighs nue nu gemit deshabille sexe nackt nackte stohnt geile geil desnuda desnudo gime sexo caliente ropa nuda geme sesso naakt seks hete undress undresses bed tongue 裸 性爱 做爱",
    "technical": "pointer cache process worker config terminal dialog plugin page column columns table query filter index server thread branch commit build test error bug daemon zombie model baseline encoding child orphan kill execute abort flush memory fichier fehler",
    "discuss": "guidelines moderators moderator moderation comments comment remove removes removed hidden warned flagged reply phrase phrases quote quoted quotes word words says say calls writer example examples policy report reported",
    "adult": "adults erwachsene adultes adultos adulti volwassenen tonight pics videos tapes",
}
#: Letters that look like Latin ones, and signs written for letters.
ALIKE = str.maketrans("аеорсхуіјѕԁһкмтвнгАЕОРСХУІЈКМТВНαεορικντυχβΑΒΕΗΙΚΜΝΟΡΤΧΥ", "aeopcxyijsdhkmtbhraeopcxyijkmtbhaeopikvtuxbabehikmnoptxy")
SIGNS = [str.maketrans("013457@$", f"o{one}eastas") for one in "il"]

#: Sentences labelled by hand: what the trees know before any rating.
TAUGHT = {
    "abusive": """You are a complete idiot and everybody knows it.|Shut up, you worthless moron.|Get lost, loser, nobody wants you here!|You stupid cow, go and die.|I will find you and break every bone in your body.|We know where you live, and you will pay for this.|One more word and I will smash your teeth.|What a pathetic clown you are.|You disgusting pig.|Halt die Klappe, du Trottel.|Du bist ein wertloser Versager.|Ich schlage dir die Knochen kaputt.|Ferme ta gueule, sale abruti.|Tu es un pauvre imbécile.|Eres un idiota inútil.|Cállate, payaso.|Sei un cretino inutile.|Stai zitto, stronzo.|Você é um otário nojento.|Cala a boca, seu burro.|Je bent een nutteloze sukkel.|Hou je mond, klootzak.|你这个白痴！|闭嘴，废物。|滚。|白痴！|I hope you rot, you spineless bastard.|Your mother must be ashamed of you, you brainless fool.|Crawl back under your stone, scumbag.|You deserve to be beaten until you bleed.""",
    "hateful": """These people are vermin and must be wiped out.|All of them are parasites who breed like rats.|Foreigners are filth, drive them out of our country.|Women are too stupid to vote.|That race is subhuman and does not deserve to live.|Migrants are animals, lock the whole lot in cages.|They are a disease in our town and should be deported.|Alle Ausländer sind Ungeziefer und müssen raus.|Dieses Volk hat kein Recht zu leben.|Ces étrangers sont de la vermine, dehors.|Tous ces gens sont des parasites.|Los extranjeros son escoria, hay que echarlos.|Todos ellos son ratas y no merecen vivir.|Gli stranieri sono feccia, fuori tutti.|Esse povo é uma praga de parasitas.|Vreemdelingen zijn tuig en moeten eruit.|Dat volk is ongedierte.|Never trust that tribe, born criminals the lot of them.|Gas the whole lot, there is not one decent among those people.|Believers of that kind should be burned out of their homes.""",
    "sexual": """She moans as he slides his hand between her thighs.|Naked and panting, she begged for sex.|Hot nude pics and porn videos, adults only.|His lover strips slowly and lies naked on the bed.|Horny tonight? Come and have sex with me.|Uncensored sex tapes of a naughty wife.|Sie stöhnt nackt auf dem Bett.|Geile nackte Frauen, nur für Erwachsene.|Elle gémit, nue, sur le lit.|Il la déshabille et ils font l'amour, sexe torride.|Ella gime desnuda en la cama.|Videos de sexo, solo adultos.|Lei geme nuda sul letto.|Sesso caldo stanotte.|Ela geme nua na cama.|Ze kreunt naakt op het bed.|Hete seks vannacht.|I want to lick every inch of your naked body.|He undressed her and their bodies moved together under the sheets until she came.|Her tongue ran down his chest and below his belt.""",
    "none": """The parser reads every file in the folder before the cache expires.|A second reviewer checks the totals and writes a line to the log.|You can change your settings on the next page.|Thank you for your help with the report.|The dumb terminal prints garbage.|Kill the orphan process and abort the child.|The daemon hangs and the zombie process is killed.|Sorry, I was such an idiot, I forgot to save the file.|I feel stupid for missing that typo.|My code is rubbish, I will fix it tomorrow.|Guidelines: a reply that calls someone a moron is hidden.|Moderators remove comments that say "you idiot" to a writer.|The word "vermin" was flagged in two quoted examples.|The policy names phrases like "shut up, loser" as insults.|The page on sex education was updated.|The survey asks for age, sex and country.|Breast cancer screening starts at fifty.|The naked pointer is wrapped in a class.|The table lists the people of each town.|Refugees and their families were given food and rooms.|Farmers fight rats and other vermin in the barn.|The parasite infects cattle in wet regions.|Strip the blanks from the column before the query.|Der Parser liest alle Dateien im Ordner.|Du kannst die Einstellungen auf der nächsten Seite ändern.|Der Prozess wurde beendet, der Fehler ist behoben.|Le lecteur vérifie tous les fichiers du dossier.|Vous pouvez modifier vos réglages ici.|El lector revisa todos los archivos de la carpeta.|Puedes cambiar tus ajustes en la página siguiente.|Il lettore controlla tutti i file della cartella.|Puoi cambiare le tue impostazioni qui.|O leitor verifica todos os ficheiros da pasta.|De lezer controleert alle bestanden in de map.|Je kunt je instellingen hier wijzigen.|解析器读取目录中的所有文件。|您可以在下一页更改设置。|We break the text into words and beat the old time by a second.|The build is broken, please fix the test before you merge.|Nobody has to reload the page.|Hit the button twice to shut the dialog.|The school offers sex education from grade seven.|The form has fields for sex and date of birth.|Age, sex and weight of each patient are kept in the table.|Leaflets on sexual health lie at the desk.|The report quotes posts that call migrants parasites.|Moderators delete posts that call a whole people rats.|Hate speech such as "they are vermin" was counted in the study.|A filter catches the word "nude" in file names.|The reviewers discussed whether calling a person a loser breaks the rules.|The dead process holds the lock, kill it.|The naked eye can't see the mark.|The master branch rejects the push of the slave node.|The crop suffers from a fungal disease.|The animals live in clean cages.|Criminals were sentenced by the court.|Er wurde dumm behandelt, steht im Bericht.|Le sexe de chaque patient figure dans la table.|La base de datos guarda el sexo y la edad.|What an idiot I am, I deleted the wrong branch.|We lost the game because I was useless.|The teeth of the gear break under load.|What a beautiful day, see you tonight.|Can you send me the pictures of the new house?""",
}

KINDS = tuple(LEXICONS)
LEXICON: dict[str, int] = {}
for _n, _words in enumerate(LEXICONS.values()):
    for _w in _words.split():
        LEXICON[_w] = LEXICON.get(_w, 0) | 1 << _n
HARD = tuple(w for w in LEXICONS["insult"].split() + LEXICONS["sexual"].split() if len(w) >= 5 and w.isascii())
HARSH = sum(1 << KINDS.index(k) for k in ("insult", "scorn", "dismiss", "threat", "degrade"))

_IN = r"[^\W_㐀-鿿]|[­​-‏⁠﻿̀-ͯ]"
#: Words (dotted, spaced and masked ones whole), Han characters, runs of marks, ends of lines.
TOKEN = re.compile(rf"[^\W\d_](?: [^\W\d_]){{3,}}(?!\w)|(?:{_IN})+(?:[.\-_'’*]+(?:{_IN})+)*|[㐀-鿿]|\\n|\n|[^\w\s\\]+|\\")
INVISIBLE = re.compile(r"[­​-‏⁠﻿]")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
APART = re.compile(r"[^\W\d_]([.\-*_ ])[^\W\d_](?:\1[^\W\d_])+$")
ENDING = re.compile(r"[.!?。！？]|[\"\]}»”],|^(?:\\n|\n)$")


def plain(word: str) -> tuple[list[str], int]:
    """A word without obfuscation, as one or several words, and how many signs of obfuscation were undone."""
    text, undone = word, 0
    if not text.isascii():
        text = INVISIBLE.sub("", text)
        undone = len(word) - len(text)
        mapped = text.translate(ALIKE)
        if mapped != text and re.search(r"[a-zA-Z]", text):
            undone += sum(a != b for a, b in zip(mapped, text))
            text = mapped
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = text.lower()
    if APART.match(text):
        text, undone = re.sub(r"[.\-*_ ]", "", text), undone + 3
    if "*" in text.strip("*"):
        shape = re.compile(re.sub(r"\*", ".", text) + "$")
        text, undone = next((h for h in HARD if shape.match(h)), text), undone + 2
    out = []
    for w in re.findall(r"[^\W_]+", text):
        if STRETCHED.search(w):
            w, undone = STRETCHED.sub(r"\1", w), undone + 2
        if any(c.isdigit() for c in w) and any(c.isalpha() for c in w):
            found = next((p for p in map(w.translate, SIGNS) if p in LEXICON), None)
            if found:
                w, undone = found, undone + 2
        out.append(w)
    return out, undone


def words_of(text: str, known: dict[str, list[str]] | None = None) -> list[list[str]]:
    """The plain words of each sentence. known: remembers tokens seen before."""
    known = {} if known is None else known
    out: list[list[str]] = [[]]
    for t in TOKEN.findall(text):
        if t[0].isalnum() or INVISIBLE.match(t[0]):
            if t not in known:
                known[t] = plain(t)[0]
            out[-1] += known[t]
        elif ENDING.search(t):
            out.append([])
    return [s for s in out if s]


def grams(words: list[str]) -> list[str]:
    """Words and neighbouring pairs."""
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


Learned = dict[str, tuple[float, ...]]  # word or word pair -> log odds per category, as ratings single it out

SHAPE = ("words", "capitals", "marks", "exclaims", "undone", "undone_rate", "quotes", "named", "person_harsh", "group_harsh", "person_sexual", "discuss_harsh", "person_learned")
WIDTH = len(SHAPE) + 2 * len(KINDS) + 2 * len(CATEGORIES)
_WORD, _MASK, _UPPER, _LETTERS, _UNDONE, _MARKS, _EXCLAIM, _QUOTE, _NAMED, _END, _IS = range(11)


class Reader:
    """Texts to sentences with dense features. Every distinct token is looked at once; all else is arithmetic on whole batches."""

    REMEMBERED = 400_000

    def __init__(self, learned: Learned) -> None:
        self.learned = learned
        pairs = [g.split(" ") for g in learned if " " in g] + [list(w) for w in LEXICON if len(w) == 2 and "㐀" <= w[0] <= "鿿"]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys([*(g for g in learned if " " not in g), *(w for p in pairs for w in p)]), 1)}
        size = len(self.vocabulary) + 1
        self.weights = np.zeros((size, len(CATEGORIES)))
        both: dict[int, tuple[int, tuple[float, ...]]] = {}
        for a, b in pairs:
            key = self.vocabulary[a] * size + self.vocabulary[b]
            both[key] = (LEXICON.get(a + b, 0) if len(a) == len(b) == 1 else 0, learned.get(f"{a} {b}", (0.0,) * len(CATEGORIES)))
        for g, row in learned.items():
            if " " not in g:
                self.weights[self.vocabulary[g]] = row
        self.pair_keys = np.array(sorted(both), np.int64)
        self.pair_masks = np.array([both[k][0] for k in sorted(both)], np.int64)
        self.pair_weights = np.array([both[k][1] for k in sorted(both)]).reshape(-1, len(CATEGORIES))
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, 11), np.int32)

    def _row(self, token: str) -> int:
        n = self.rows[token] = len(self.rows)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        row = self.table[n]
        if token[0].isalnum() or INVISIBLE.match(token[0]):
            parts, row[_UNDONE] = plain(token)
            row[_IS] = 1
            for p in parts:
                row[_MASK] |= LEXICON.get(p, 0)
            whole = "".join(parts)
            row[_MASK] |= LEXICON.get(whole, 0)
            row[_WORD] = next((self.vocabulary[p] for p in (whole, *parts) if p in self.vocabulary), 0)
            row[_UPPER], row[_LETTERS] = sum(c.isupper() for c in token), sum(c.isalpha() for c in token)
            row[_NAMED] = token[0].isupper() and not token.isupper()
        else:
            row[_MARKS], row[_EXCLAIM], row[_QUOTE], row[_END] = len(token), token.count("!") + token.count("！"), sum(c in "\"“”„«»" for c in token), bool(ENDING.search(token))
        return n

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(document number, features) of every sentence that has words, in order."""
        if len(self.rows) > self.REMEMBERED:
            self._forget()
        lists = [TOKEN.findall(t) if t else [] for t in texts]
        counts = np.array([len(x) for x in lists])
        rows, make = self.rows, self._row
        ids = np.fromiter((rows[t] if t in rows else make(t) for ts in lists for t in ts), np.int64, int(counts.sum()))
        if not len(ids):
            return np.empty(0, np.int64), np.zeros((0, WIDTH))
        a = self.table[ids]
        document = np.repeat(np.arange(len(lists)), counts)
        first = np.r_[True, (document[1:] != document[:-1]) | (a[:-1, _END] > 0)]
        sentence = np.cumsum(first) - 1
        # sentences without words go
        held = np.bincount(sentence, a[:, _IS])
        keep = held > 0
        if not keep.any():
            return np.empty(0, np.int64), np.zeros((0, WIDTH))
        owner = document[first][keep]
        number = np.cumsum(keep) - 1
        use = keep[sentence]
        a, sentence = a[use], number[sentence[use]]
        n = len(owner)
        total = lambda v: np.bincount(sentence, v, n)
        count = total(a[:, _IS])
        w = a[a[:, _IS] > 0]
        at = sentence[a[:, _IS] > 0]
        mask = w[:, _MASK].astype(np.int64)
        weight = self.weights[w[:, _WORD]]
        if len(self.pair_keys) and len(w) > 1:
            key = np.where((at[1:] == at[:-1]) & (w[1:, _WORD] > 0) & (w[:-1, _WORD] > 0), w[:-1, _WORD].astype(np.int64) * len(self.weights) + w[1:, _WORD], -1)
            hit = np.flatnonzero(key >= 0)
            place = np.minimum(np.searchsorted(self.pair_keys, key[hit]), len(self.pair_keys) - 1)
            right = self.pair_keys[place] == key[hit]
            hit, place = hit[right], place[right]
            mask[hit] |= self.pair_masks[place]
            weight[hit] += self.pair_weights[place]
        out = np.zeros((n, WIDTH))
        s = len(SHAPE)
        for k in range(len(KINDS)):
            found = np.bincount(at, mask >> k & 1, n)
            out[:, s + k] = found
            out[:, s + len(KINDS) + k] = found / count
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        for c in range(len(CATEGORIES)):
            out[:, WIDTH - 6 + 2 * c] = np.add.reduceat(weight[:, c], starts)
            out[:, WIDTH - 5 + 2 * c] = np.maximum.reduceat(weight[:, c], starts)
        bit = lambda kind: mask >> KINDS.index(kind) & 1 > 0
        harsh, person = mask & HARSH > 0, bit("person")
        undone = total(a[:, _UNDONE])
        out[:, :s] = np.stack(
            [
                np.log1p(count), total(a[:, _UPPER]) / np.maximum(total(a[:, _LETTERS]), 1), total(a[:, _MARKS]) / count, total(a[:, _EXCLAIM]), undone, undone / count, total(a[:, _QUOTE]), total(a[:, _NAMED]) / count,
                nearness(at, harsh, person, n), nearness(at, harsh, bit("group"), n), nearness(at, bit("sexual"), person, n), nearness(at, harsh, bit("discuss"), n), nearness(at, weight[:, 0] > 0.5, person, n),
            ],
            1,
        )
        return owner, out


def nearness(at: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Per sentence 1 / (1 + words between the nearest a and b), 0 where it lacks either."""
    out = np.zeros(n)
    here = np.flatnonzero(a)
    there = np.flatnonzero(b)
    if len(here) and len(there):
        right = np.searchsorted(there, here)
        for place in (np.minimum(right, len(there) - 1), np.maximum(right - 1, 0)):
            other = there[place]
            same = at[other] == at[here]
            np.maximum.at(out, at[here[same]], 1 / (1 + np.abs(other[same] - here[same])))
    return out


def learn_words(sentences: list[set[str]], labels: list[set[str]], least: float = 0.3, z: float = 1.64) -> Learned:
    """Words and pairs of which the rated documents that hold them are surely (lower Wilson bound) of a category in a share of
    at least `least`; the value is half the log odds of that bound against the category's share of all rated documents."""
    seen = Counter(g for ws in sentences for g in ws)
    out: Learned = {}
    for c, name in enumerate(CATEGORIES):
        inside = Counter(g for ws, ls in zip(sentences, labels) if name in ls for g in ws)
        rate = (sum(name in ls for ls in labels) + 1) / (len(labels) + 2)
        for g, a in inside.items():
            if a >= 3:
                n, p = seen[g], a / seen[g]
                low = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
                if low >= least:
                    row = list(out.get(g, (0.0,) * len(CATEGORIES)))
                    row[c] = max(0.0, 0.5 * float(np.log(low / (1 - low)) - np.log(rate / (1 - rate))))
                    out[g] = tuple(row)
    return out


class Model:
    """Learned words, trees and calibration per category."""

    def __init__(self, learned: Learned, trees: list[Trees], knots: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.learned, self.trees, self.knots = learned, trees, knots

    def score(self, texts: list[str | None], reader: Reader | None = None) -> np.ndarray:
        """Probabilities (document, category): each document's worst sentence; 0 where there is none."""
        out = np.zeros((len(texts), len(CATEGORIES)))
        owner, x = (reader or Reader(self.learned)).read(texts)
        for c in range(len(CATEGORIES)):
            worst = np.full(len(texts), -np.inf)
            np.maximum.at(worst, owner, self.trees[c].margin(x))
            some = np.isfinite(worst)
            out[some, c] = np.interp(worst[some], *self.knots[c])
        return out


def _worst(owner: np.ndarray, margin: np.ndarray, n: int) -> np.ndarray:
    """Each document's sentence of greatest margin, the first of several; -1 where it has none."""
    order = np.lexsort((-np.arange(len(margin)), margin, owner))
    out = np.full(n, -1)
    out[owner[order]] = order
    return out


def _grow(owner: np.ndarray, x: np.ndarray, share: np.ndarray, rounds: int = 2) -> list[Trees]:
    """Trees per category. share: of each document's raters, the part that named the category (document, category)."""
    n, bins = len(share), Bins(x)
    clean = ~share.any(1)
    made = []
    taught = np.arange(n) >= n - sum(t.count("|") + 1 for t in TAUGHT.values())
    single = np.isin(np.arange(len(x)), _worst(owner, np.zeros(len(x)), n)) & (np.bincount(owner, minlength=n)[owner] == 1)
    negative = np.flatnonzero(clean[owner])
    # at first the documents of one sentence teach, which the taught ones are, and the words that ratings single out tell the rest
    for c in range(len(CATEGORIES)):
        sure = np.flatnonzero(single & (share[owner, c] > 0) & taught[owner])
        rows = np.r_[negative, sure]
        made.append(Trees(rounds=15).fit(x, np.r_[np.zeros(len(negative)), share[owner[sure], c]], np.ones(len(rows)), bins, rows))
    margins = [made[c].margin(x) + 2 * x[:, WIDTH - 6 + 2 * c] for c in range(len(CATEGORIES))]
    for r in range(rounds):
        witness = [_worst(owner, m, n) for m in margins]
        for c in range(len(CATEGORIES)):
            mine = np.flatnonzero((share[:, c] > 0) & (witness[c] >= 0))
            at = witness[c][mine]
            # what shows another category in a document without this one
            other = np.concatenate([witness[d][(share[:, d] > 0) & (share[:, c] == 0) & (witness[d] >= 0)] for d in range(len(CATEGORIES)) if d != c])
            rows = np.r_[negative, at, other]
            target = np.r_[np.zeros(len(negative)), share[mine, c], np.zeros(len(other))]
            made[c] = Trees(rounds=25 if r < rounds - 1 else 50).fit(x, target, np.ones(len(rows)), bins, rows)
        margins = [made[c].margin(x) for c in range(len(CATEGORIES))]
    return made


def fit(texts: list[str], shares: list[dict[str, float]]) -> Model:
    """shares: per text the part of its raters that named each category. Without any texts TAUGHT alone decides.

    Features of a fold use words learned on the others, so that the trees meet them as they meet unseen documents.
    """
    seeds = [(s, {k: 1.0} if k != "none" else {}) for k, all_ in TAUGHT.items() for s in all_.split("|")]
    texts, shares = [*texts, *(s for s, _ in seeds)], [*shares, *(x for _, x in seeds)]
    share = np.array([[x.get(c, 0.0) for c in CATEGORIES] for x in shares])
    labels = [{c for c in CATEGORIES if x.get(c, 0) >= 0.5} for x in shares]
    fold = np.array([xxhash.xxh32_intdigest(t) % FOLDS for t in texts])
    known: dict[str, list[str]] = {}
    held = [set(g for s in words_of(t, known) for g in grams(s)) for t in texts]
    parts = []
    for k in range(FOLDS):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        owner, x = Reader(learn_words([held[i] for i in rest], [labels[i] for i in rest])).read([texts[i] for i in own])
        parts.append((own[owner], x))
    owner, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(owner, kind="stable")
    owner, x = owner[order], x[order]
    unseen = np.full(share.shape, np.nan)
    for k in range(FOLDS):
        inside = fold[owner] == k
        made = _grow(owner[~inside], x[~inside], share)
        for c in range(len(CATEGORIES)):
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, owner[inside], made[c].margin(x[inside]))
            unseen[fold == k, c] = top[fold == k]
    final = _grow(owner, x, share)
    knots = []
    for c in range(len(CATEGORIES)):
        some = np.isfinite(unseen[:, c])
        knots.append(isotonic(unseen[some, c], share[some, c], np.ones(some.sum())))
    return Model(learn_words(held, labels), final, knots)


def fit_on(docs: DataFrame, ratings: DataFrame, bound: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on the rated documents, at most `bound` of them (least hash of the id), none over FIT_CHARACTERS. Null categories count as no rating."""
    each = ratings.where("category IS NOT NULL").groupBy(F.col("doc_id").alias("_rated"))
    rated = each.agg(*[F.avg((F.col("category") == c).cast("double")).alias(f"_{c}") for c in CATEGORIES])
    chosen = F.broadcast(least_hashed(rated, "_rated", bound))  # at most `bound` ids
    source = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= FIT_CHARACTERS)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = source.join(chosen, F.col("_id") == F.col("_rated")).select("_text", *[f"_{c}" for c in CATEGORIES]).collect()
    rows = sorted(map(tuple, rows))
    return fit([r[0] for r in rows], [dict(zip(CATEGORIES, r[1:])) for r in rows])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, abusive, hateful, sexual): a probability per category. Null and blank texts get 0; rows stay as many as they are."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(c if c not in ("id", "text", *CATEGORIES) else f"keep_{c}") for c in keep])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_ROWS

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        reader = Reader(mine.learned)
        for batch in it:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = mine.score(part.column(1).to_pylist(), reader)
                names = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + [pa.array(np.round(got[:, c], 6)) for c in range(3)], names=[*names, *CATEGORIES])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text")
    return source.mapInArrow(batches, f"{fields}, abusive double, hateful double, sexual double")
