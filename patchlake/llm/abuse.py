"""Scores for abusive, hateful or sexual content of subtitles, and rates by source.

Method: a counterfactual-regularised classifier. A sentence (which may run over two cues) is described by its words, pairs of
neighbouring words, kinds of words from a fixed general list (insults, violence, dehumanising words, sexual words, identity terms,
persons), kinds that meet in it, and threats (oneself, violence, you, in this order). A logistic model is trained on the labelled documents by multiple instances: a document is
as bad as its worst sentence, be it one with listed words or not. What names a group is, besides the listed terms, what stands
as a name after articles in the labelled texts. For each sentence with an identity term, the term is swapped for others, and the
square of the change of its score is added to the loss, so that a neutral mention of a group doesn't raise the score. Weights of
the listed kinds start from fixed values; those of words and pairs start from 0 and are learnt.

Fitting reads at most LABELLED labelled documents and LABELLED_BYTES of their texts, those of the least hash of doc_id (a text of
more than a sixteenth of these bytes is not fitted); every document is scored, whole.

Defined results: null and empty texts score 0; null labels are left out, two labels of a document are averaged and ties left
out; a document delivered again counts once; a source is trimmed and in lower case, a null or blank one is ""; no labels at
all leave the fixed weights; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.runtime import ship_package

LABELLED, LABELLED_BYTES = 4000, 64 << 20
BITS = 17
ROUNDS, STEPS, RATE, SPEED = 5, 60, 0.1, 40.0
#: Weight of the swapped identity terms in the loss, of the pull to the first weights, and to 0 for words; how far a score must
#: lie on the other side of a label to cast doubt on it; how many documents with a word halve what its share tells at first.
SWAP, PULL, PULL_WORDS, DOUBT, SUPPORT = 0.1, 0.02, 0.02, 2.0, 3
THRESHOLD = 0.5

#: Words by kind, in five languages, without accents. A final * stands for any ending.
WORDS = {
    "insult": (
        "idiot* moron* asshole* bitch* bastard* scumbag* loser* whore* slut* retard* cunt* dickhead* douchebag* motherfucker* wanker* twat* prick cockroach* maggot* imbecile* cretin* parasite shit shithead crap scum trash garbage clown pig cow dog rat"
        " puta* cabron* idiota* gilipollas pendej* imbecil* maricon* zorra* capullo* mierda basura schlampe* arschloch* hurensohn* wichser* bastard* miststuck* fotze* dreckskerl* trottel* vollidiot* schwein abschaum"
        " connard* conasse* pute salope* salaud* batard* encule* ordure* abruti* idiot* debile* сука суки тварь ублюдок ублюдк* урод* мразь* идиот* дурак дура сволочь дебил* шлюх* скотина козел"
    ),
    "strong": (
        "shit shithead puta puto pute salop* asshole* bitch* bastard* scumbag* whore* slut* retard* cunt* dickhead* motherfucker* wanker* twat* cabron* gilipollas schlampe* arschloch* hurensohn* wichser* fotze* connard* conasse* salope* salaud* encule* сука ублюдок ублюдк* мразь* шлюх*"
    ),
    "adjective": (
        "worthless pathetic stupid dumb ugly filthy disgusting useless brainless spineless greasy stinking rotten crippled inbred retarded fat smelly subhuman asquero* estupid* inutil sucio dreckig* dumm* hasslich* wertlos* sale pauvre stupide laid* тупой тупая грязн* жалк* вонюч*"
    ),
    "violence": (
        "kill* murder* strangle* stab* shoot* shot drown* gut skin slit cripple cut burn* bury break beat hang hanged die burn choke* smash* punch* rape* matar matare mato degollar umbringen töten toten schlage schlag erwurge tuer tue egorger etrangler убью убить зарежу задушу прирежу"
    ),
    "end": "hang* die kill yourself neck throat family sleep house tot muerto mort",
    "dehumanise": (
        "vermin* rat rats scum subhuman trash animal animals parasite* parasit* filth cockroach* ungeziefer vermine ratas alimanas паразит* крысы нелюди disgust* inferior savage* plague disease exterminate* deport* raus dehors abschaum untermensch*"
    ),
    "sexual": (
        "fuck* fucking sex moan* breast* panties ass tits pussy cock dick orgasm* naked horny lick* bang ride screw screams bed nude blowjob cum thrust* undress* follar follaban follando desnud* gemia gemir coger fick* nackt* stohn* baisa* baiser nue gemissait sucer трах* голая голый стонала"
    ),
    "act": "fuck* moan* lick* panties tits pussy orgasm* blowjob follaban follar follando gemia fickten ficken stohnte baisaient baiser gemissait трах* стонала",
    "identity": (
        "women woman men girls gays gay lesbian* jews jew muslims muslim christians blacks black asians asian immigrants immigrant foreigners foreigner refugees gypsies cripples cripple disabled blind deaf mujeres moros judios frauen juden auslander femmes juifs arabes женщин* евре*"
    ),
    "you": "you your you're youre yourself u ya eres te tu ti vosotros usted du dich dir dein* ihr toi ton ta tes vous t'es ты тебя тебе твой твоя вы",
    "self": "i i'll ill we we'll voy ich wir je vais nous я мы",
    "person": "him her them they he she your you his family mother everyone them all ihnen ihn sie alle tous todos les los все их него неё",
    "order": "shut halt ferme callate заткнись lost get out dehors raus fresse gueule mund boca рот",
}
#: Kinds that mean most where they meet in one sentence, and what single kinds and meetings weigh before training.
MEETINGS = {
    ("insult", "you"): 3.6,
    ("insult", "order"): 2.5,
    ("insult", "adjective"): 2.5,
    ("strong", "strong"): 2.5,
    ("strong", "person"): 1.0,
    ("adjective", "you"): 0.6,
    ("violence", "you"): 1.2,
    ("violence", "self"): 0.8,
    ("violence", "identity"): 2.5,
    ("violence", "insult"): 2.5,
    ("end", "you"): 0.8,
    ("dehumanise", "identity"): 3.5,
    ("insult", "identity"): 2.5,
    ("adjective", "identity"): 2.5,
    ("order", "identity"): 1.5,
    ("act", "sexual"): 2.0,
    ("act", "person"): 1.5,
    ("sexual", "person"): 0.4,
    ("sexual", "sexual"): 1.0,
}
SINGLE = {"insult": 0.3, "strong": 2.6, "adjective": 0.2, "violence": 0.2, "end": 0.0, "dehumanise": 0.0, "sexual": 0.4, "act": 1.5, "identity": 0.0, "you": 0.0, "self": 0.0, "person": 0.0, "order": 0.2}
#: What it weighs that one speaks of oneself, then of violence, and within REACH words of "you"; and that an insult stands alone.
THREAT, REACH, ALONE = 3.0, 4, 1.5
BIAS = -4.0
#: Signs written for letters, and letters that look like Latin ones.
LEET = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "€": "e", "£": "l"})
LOOKALIKE = str.maketrans("аеорсухіјѕԁһвнкмтАЕОРСУХІЈВНКМТαοερικνΑΒΕΗΙΚΜΝΟΡΤΧ", "aeopcyxijsdhbhkmtAEOPCYXIJBHKMTaoepiknABEHIKMNOPTX")
HIDDEN = re.compile("[­​-‏⁠-⁤﻿͏]")
SPELT = re.compile(r"(?<![\w'])(?:(?:\w[.\-_*·]){2,}\w|(?:\w ){3,}\w)(?![\w'])")
TOKEN = re.compile(r"[\w@$*#€£?�]+(?:[!'’][\w@$*#]+)*")
STOPS = re.compile(r"[.!?…]+[\"'»”)]*(?:\s+|$)|\n\n+|♪")
CUE = re.compile(r"^[ \t﻿]*\d+[ \t]*$|^[^\n]*-->[^\n]*$|^﻿?WEBVTT[^\n]*$|<[^<>\n]{0,60}>|\{\\?[^{}\n]{0,40}\}|\[[^\[\]\n]{0,60}\]|^[ \t]*(?:-|–|>>)[ \t]*", re.MULTILINE)
SPEAKER = re.compile(r"^(?:[ \t]*[-–][ \t]*)?[A-ZÀ-ÖØ-ÞА-Я][A-ZÀ-ÖØ-ÞА-Я0-9 .'-]{1,24}:[ \t]*", re.MULTILINE)

_state: dict = {}


def squeeze(word: str) -> str:
    """A word without accents, repeated letters, and the letters that misreading confuses."""
    word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    word = re.sub(r"(.)\1+", r"\1", word)
    return word.replace("rn", "m").replace("vv", "w").replace("l", "i")


def _lexicon() -> tuple[dict[str, tuple[str, ...]], list[tuple[str, str]], dict]:
    if "whole" not in _state:
        whole: dict[str, set[str]] = {}
        stems: list[tuple[str, str]] = []
        masks: dict = {}
        for kind, words in WORDS.items():
            for w in words.split():
                plain = w.rstrip("*")
                whole.setdefault(squeeze(plain), set()).add(kind)
                if w.endswith("*"):
                    stems.append((squeeze(plain), kind))
                for end in ("", "s", "ed", "d", "e") if len(plain) > 3 and plain.isascii() else ("",):
                    x = plain + end
                    if len(x) > 2:
                        masks.setdefault((x[0], x[-1], len(x)), set()).add(plain)
        _state["whole"] = {k: tuple(sorted(v)) for k, v in whole.items()}
        _state["stems"] = sorted(stems)
        _state["masks"] = masks
        _state["kinds"] = {}
    return _state["whole"], _state["stems"], _state["masks"]


def kinds_of(key: str) -> tuple[str, ...]:
    whole, stems, _ = _lexicon()
    known = _state["kinds"]
    if key not in known:
        if len(known) > 500_000:
            known.clear()
        own = set(whole.get(key, ()))
        own |= {kind for stem, kind in stems if key.startswith(stem) and len(key) - len(stem) <= 4}
        known[key] = tuple(sorted(own))
    return known[key]


def plain_word(token: str) -> str:
    """A token as the word it disguises."""
    known = _state.setdefault("plain", {})
    if token in known:
        return known[token]
    if len(known) > 500_000:
        known.clear()
    low = token.lower().replace("’", "'")
    if low.isascii() and low.isalpha():
        known[token] = squeeze(low)
        return known[token]
    word = unicodedata.normalize("NFKC", low)
    if not word.isascii() and any("a" <= c <= "z" for c in word):
        word = word.translate(LOOKALIKE)
    if any(c.isalpha() for c in word):
        word = word.translate(LEET)
    if re.search(r"[*#?�]", word.strip("*#?")) or re.search(r"\w[*#]+$", word):
        word = word.strip("?")
        base = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
        shape = re.compile("".join("." if c in "*#?�" else re.escape(c) for c in base) + r"\Z")
        _, _, masks = _lexicon()
        for x in sorted(masks.get((base[:1], base[-1:], len(base)), ())):
            if shape.match(x) or any(shape.match(x + e) for e in ("s", "ed", "d", "e")):
                word = x
                break
        else:
            word = word.replace("*", "").replace("#", "")
    known[token] = squeeze(word)
    return known[token]


GARBLED = re.compile(r"[\u0080-ɏЀ-џ‘-™]{2,}")


def repaired(text: str) -> str:
    """The text with words that were read in a wrong encoding put right, where that gives plain letters."""
    if text.isascii():
        return text

    def one(m: re.Match) -> str:
        s = m[0]
        for wrong, right in (("cp1252", "utf-8"), ("cp1251", "utf-8"), ("latin-1", "utf-8"), ("cp1252", "cp1251")):
            try:
                t = s.encode(wrong).decode(right)
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
            if right == "utf-8" and len(t) < len(s) or right == "cp1251" and len(s) >= 3 and all("а" <= c.lower() <= "я" or c in "ёЁ" for c in t):
                return t
        return s

    return GARBLED.sub(one, text)


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, disguises undone."""
    text = repaired(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = HIDDEN.sub("", SPEAKER.sub("", CUE.sub("", text)))
    text = SPELT.sub(lambda m: re.sub(r"[ .\-_*·]", "", m[0]), text)
    # a line between two cues joins the sentence that runs over it
    text = re.sub(r"\n\s*", " ", text)
    known = _state.setdefault("plain", {})
    return [[known.get(t) or plain_word(t) for t in TOKEN.findall(s)] for s in STOPS.split(text) if s and not s.isspace()]


#: Kinds that meet others but never each other.
PERSONS = {"you", "self", "person"}
NAMES = [*SINGLE, *("+".join(k) for k in MEETINGS), "threat", "alone"]
FIXED = np.array([*SINGLE.values(), *MEETINGS.values(), THREAT, ALONE])
_AT = {n: k for k, n in enumerate(NAMES)}
#: A capitalised word within a sentence, after an English article: what may name a group.
NAMED = re.compile(r"(?<=[a-z,;] )(?:[Tt]he|an?|those|these|every|all|some) (?:[a-z]+ )?([A-Z][a-z]{2,})\b(?!')")


def group_names(texts: list[str], least: int = 3) -> frozenset[str]:
    """The squeezed words that stand as names after articles in at least so many of the texts and in no text in lower case."""
    count: dict[str, int] = {}
    plain: set[str] = set()
    for text in texts:
        body = SPEAKER.sub("", CUE.sub("", text))
        for w in set(NAMED.findall(body)):
            count[w] = count.get(w, 0) + 1
        plain.update(re.findall(r"\b[a-z]{3,}\b", body))
    return frozenset(plain_word(w) for w, n in count.items() if n >= least and w.lower() not in plain)


def features(words: list[str], known: dict[str, int], names: frozenset[str] = frozenset(), identity: str | None = None) -> list[int]:
    """The numbers of a sentence's features; names: further identity terms; identity: what stands for the identity terms."""
    import xxhash

    seen = _state.setdefault("kinds", {})
    own = [seen[w] if w in seen else kinds_of(w) for w in words]
    if not names.isdisjoint(words):
        own = [tuple({*k, "identity"}) if w in names else k for w, k in zip(words, own)]
    if identity is not None:
        words = [identity if "identity" in k else w for w, k in zip(words, own)]
    count: dict[str, int] = {}
    for k in own:
        for x in k:
            count[x] = count.get(x, 0) + 1
    out = [_AT[k] for k in count]
    for a, b in MEETINGS if not count.keys() <= PERSONS else ():
        # one word that is of both kinds is no meeting
        if a in count and b in count and (count[a] > 1 if a == b else any(a in x and b in y for i, x in enumerate(own) for j, y in enumerate(own) if i != j)):
            out.append(_AT[f"{a}+{b}"])
    if "violence" in count and "self" in count and "you" in count:
        speaks = next(i for i, k in enumerate(own) if "self" in k)
        acts = [i for i, k in enumerate(own) if "violence" in k and i > speaks]
        if any("you" in x for i in acts for x in own[i + 1 : i + 1 + REACH]):
            out.append(_AT["threat"])
    if len(words) < 3 and "insult" in count:
        out.append(_AT["alone"])
    if len(known) > 500_000:
        known.clear()
    keys = [*words, *[f"{a} {b}" for a, b in zip(words, words[1:])]]
    hashed = [known.get(w) for w in keys]
    if None in hashed:
        for k, w in enumerate(keys):
            if hashed[k] is None:
                hashed[k] = known[w] = len(NAMES) + (xxhash.xxh64_intdigest(w) & ((1 << BITS) - 1))
    return out + hashed


class Model:
    """Weights of the listed kinds and meetings, of words and pairs of words, and the bias last; and the names of groups."""

    def __init__(self, weight: np.ndarray, names: frozenset[str] = frozenset()):
        self.weight, self.names = weight, names


def untrained() -> np.ndarray:
    weight = np.zeros(len(NAMES) + (1 << BITS) + 1)
    weight[: len(NAMES)] = FIXED
    weight[-1] = BIAS
    return weight


def fit(labelled: list[tuple[str, float]], swap: float = SWAP) -> Model:
    """The model of (text, label) of documents.

    A document that is labelled as abusive lends its label to its worst sentence, found anew each round; of one that isn't, the
    sentences that were worst in any round so far are negative. Labels that the model of the round before contradicts strongly
    count little, as some labels are wrong.
    """
    prior = untrained()
    size = len(prior) - 1
    names = group_names([t for t, _ in labelled])
    known: dict[str, int] = {}
    rows, docs, lines = [], [], []
    for d, (text, _) in enumerate(labelled):
        for words in filter(None, sentences(text)):
            rows.append(np.unique(features(words, known, names)))
            docs.append(d)
            lines.append(words)
    label = np.array([y for _, y in labelled]) > 0.5
    if not rows or len(set(label.tolist())) < 2:
        return Model(prior, names)
    doc = np.array(docs)

    def flat(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(xs), np.repeat(np.arange(len(xs)), [len(x) for x in xs])

    col, row = flat(rows)
    others = ["someone", *sorted(names)[:2], "women", "foreigners"][:4]
    identity = [any("identity" in kinds_of(w) for w in x) or not names.isdisjoint(x) for x in lines]
    weight, active = prior.copy(), np.zeros(len(rows), bool)
    pull = np.full(size + 1, PULL_WORDS)
    pull[: len(NAMES)] = pull[size] = PULL
    pull *= max(1.0, 800 / len(labelled))  # few labels say little
    # at first, what is told of a sentence is also how much more of the abusive documents hold its words
    held = np.unique(doc[row] * (size + 1) + col)
    with_, of = held % (size + 1), label[held // (size + 1)]
    bad, good = np.bincount(with_[of], minlength=size + 1), np.bincount(with_[~of], minlength=size + 1)
    odds = (np.log((bad + 0.5) / (label.sum() + 1)) - np.log((good + 0.5) / ((~label).sum() + 1))) * bad / (bad + SUPPORT)
    first = np.bincount(row, odds[col], len(rows)) / np.bincount(row, minlength=len(rows))
    for round_ in range(ROUNDS):
        s = np.bincount(row, weight[col], len(rows)) + weight[size]
        if not round_:
            s += 4 * first
        order = np.lexsort((s, doc))
        worst = order[np.append(np.flatnonzero(np.diff(doc[order])), len(order) - 1)]
        active[label[doc]] = False
        active[worst] = True
        use = np.flatnonzero(active)
        y = label[doc[use]].astype(float)
        trust = np.where(np.where(y > 0.5, -s[use], s[use]) > DOUBT, 0.1, 1.0) if round_ else np.ones(len(use))
        a_col, a_row = flat([rows[i] for i in use])
        # each sentence with an identity term once more for each other term in its place
        swapped = [(k, np.unique(features(lines[i], known, names, o))) for k, i in enumerate(use) if identity[i] for o in others] if swap else []
        at = np.array([k for k, _ in swapped], np.int64)
        s_col, s_row = flat([x for _, x in swapped]) if swapped else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        moment = np.zeros(size + 1)
        for _ in range(STEPS):
            s = np.bincount(a_row, weight[a_col], len(use)) + weight[size]
            g = trust * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y)
            if swapped:
                change = s[at] - np.bincount(s_row, weight[s_col], len(swapped)) - weight[size]
                push = 2 * swap * change / len(others)
                np.add.at(g, at, push)
            grad = np.bincount(a_col, g[a_row], size + 1)
            grad[size] = (g.sum() - push.sum()) if swapped else g.sum()
            if swapped:
                grad -= np.bincount(s_col, push[s_row], size + 1)
            grad = grad / len(labelled) * SPEED + pull * (weight - prior)
            moment = 0.8 * moment + grad
            weight -= RATE * moment
    return Model(weight, names)


def score_text(text: str | None, model: Model, known: dict[str, int]) -> float:
    """The score of a document: that of its worst sentence, from 0 to 1."""
    lines = [x for x in sentences(text) if x] if text else []
    value, names = model.weight.item, model.names
    bias = value(-1)
    best = max((sum(map(value, set(features(words, known, names)))) for words in lines), default=None)
    return 0.0 if best is None else float(1 / (1 + np.exp(-np.clip(best + bias, -30, 30))))


def labelled_documents(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, size: int = LABELLED_BYTES) -> list[tuple[str, float]]:
    """The labelled texts that are fitted: at most bound documents and size bytes of them, in order of the hash of doc_id."""
    own = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.avg(F.col("toxic").cast("double")).alias("y"))
        .where("y <> 0.5")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= size // 16)).join(F.broadcast(own), "doc_id").dropDuplicates(["doc_id"])
    # one task counts up the bytes of at most bound texts of at most a sixteenth of size
    running = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = texts.withColumn("bytes", running).where(F.col("bytes") <= size).select("doc_id", "text", "y").collect()
    return [(r["text"], float(r["y"] > 0.5)) for r in sorted(rows, key=lambda r: r["doc_id"])]


def scores(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(doc_id, source, score) of every document."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(fit(labelled_documents(docs, labels, bound)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for rb in rows:
            s = [score_text(t, held.value, known) for t in rb.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(s, pa.float64())], ["doc_id", "source", "score"])

    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source"), "text")
    scored = plain.mapInArrow(run, "doc_id long, source string, score double")
    return scored.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("score").alias("score"))


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, labels).where(F.col("score") >= THRESHOLD).select("doc_id")


def rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, flagged, rate) of every source."""
    hit = (F.col("score") >= THRESHOLD).cast("long")
    return scores(docs, labels).groupBy("source").agg(F.count("*").alias("documents"), F.sum(hit).alias("flagged"), F.avg(hit).alias("rate"))
