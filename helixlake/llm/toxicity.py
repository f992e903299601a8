"""Toxicity: noisy-channel deobfuscation, then scoring of the restored text.

Channel. A writer who hides a word swaps letters for look-alikes, stretches letters, or sets signs
and spaces between them. Tokens that show such traces (of letters alone: one that stands twice in
a row) and give no evidence as written are decoded: each character is a column of a
lattice (itself, the letters it may stand for, or nothing for a sign or a repeat), each path costs
its channel price and its price under a character trigram model, and Viterbi finds the cheapest.
The trigram model and the lexicon are learned from all labelled documents that may be learned from.

Lexicon. Words and word beginnings that mark toxic documents: they stand in at least
``least_contexts`` different neighbourhoods of toxic documents (a parameter; by default 1 per 60 toxic
documents, held within 6 and 16, so words that merely come with copies of one
document do not count) and are ``least_ratio`` times as frequent there as elsewhere.
A beginning counts only where several different words share it. Evidence is the smoothed log odds;
the score is a logistic function of a document's strongest evidence plus half of the rest.

Edge cases: null counts as empty; an empty text scores the base rate's side (near 0); very long
texts are scored whole; without labels of both classes the lexicon is empty; repeated rows are
scored alike; other columns, also label, lang, source and id, are never inputs and are carried along.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .textops import trimmed

# Signs and digits that stand for letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SWAP_COST, DROP_COST, REPEAT_COST, KEEP_SIGN_COST = 1.5, 0.7, 0.3, 6.0
BEGINNINGS = (4, 5, 6)
EDGE = ".,;:!?\"'()[]{}<>|*#&%$-_/\\"
SPACED = re.compile(r"(?<!\w)[\w$@!|](?:[\W_]{1,3}[\w$@!|]){2,}(?!\w)")
REPEATED, STRETCHED = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
MEMO = 150_000
MOST_CONTEXTS, LEAST_RATIO, COUNTED = 16, 12.0, 60_000


def least_contexts_of(toxic: int) -> int:
    return min(MOST_CONTEXTS, max(6, toxic // 60))


def tokens_of(text: str) -> list[str]:
    return [t for t in (t.strip(EDGE) for t in text.lower().split()) if t]


def trigrams_of(tokens: Counter) -> Counter:
    """Character trigrams of tokens of letters, with the mark of a word's beginning and end."""
    found: Counter = Counter()
    for t, n in tokens.items():
        if t.isalpha():
            padded = "^^" + t + "~"
            for i in range(2, len(padded)):
                found[padded[i - 2 : i + 1]] += n
    return found


class Model:
    """A trigram character model and a lexicon of evidence, learned from rows in memory or (``fit``) from counts; picklable."""

    def __init__(self, rows: list[tuple[int, str]], least_contexts: int | None = None, least_ratio: float = LEAST_RATIO) -> None:
        self.words: dict[str, float] = {}
        self.starts: dict[str, float] = {}
        size = Counter(y for y, _ in rows)
        least_contexts = least_contexts or least_contexts_of(size[1])
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}  # documents of a class that hold a feature
        around: dict[tuple, set] = defaultdict(set)
        variants: dict[tuple, Counter] = defaultdict(Counter)
        met: Counter = Counter()
        for y, text in sorted(rows):
            tokens = tokens_of(text)
            met.update(tokens)
            seen = set()
            for i, t in enumerate(tokens):
                mine = [("w", t), *(("s", t[:n]) for n in BEGINNINGS if len(t) >= n)]
                seen.update(mine)
                if y:
                    place = (tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else "")
                    for f in mine:
                        if len(around[f]) < 4 * least_contexts:
                            around[f].add(place)
                        if f[0] == "s":
                            variants[f][t] += 1
            held[y].update(seen)
        if min(size[0], size[1]):
            for f, places in around.items():
                if len(places) < least_contexts:
                    continue
                ratio = ((held[1][f] + 0.5) / (size[1] + 1)) / ((held[0][f] + 0.5) / (size[0] + 1))
                if ratio < least_ratio:
                    continue
                if f[0] == "w":
                    self.words[f[1]] = math.log(ratio)
                elif len(variants[f]) >= 4 and variants[f].most_common(1)[0][1] < 0.5 * sum(variants[f].values()):
                    self.starts[f[1]] = math.log(ratio)
        self._prices(trigrams_of(met))

    @classmethod
    def of(cls, words: dict[str, float], starts: dict[str, float], trigrams: Counter) -> Model:
        made = cls.__new__(cls)
        made.words, made.starts = words, starts
        made._prices(trigrams)
        return made

    def _prices(self, trigrams: Counter) -> None:
        context: Counter = Counter()
        for g, n in trigrams.items():
            context[g[:2]] += n
        letters = len({g[2] for g in trigrams}) + 1
        self.price = {g: -math.log((n + 0.1) / (context[g[:2]] + 0.1 * letters)) for g, n in trigrams.items()}
        self.unseen = {c: -math.log(0.1 / (n + 0.1 * letters)) for c, n in context.items()}
        self.blank = math.log(letters)

    def _price(self, context: str, c: str) -> float:
        got = self.price.get(context + c)
        return got if got is not None else self.unseen.get(context, self.blank)

    def decode(self, token: str) -> str:
        """The cheapest reading of an obfuscated token: Viterbi over its whole character lattice, no path is cut."""
        best = {("^^", ""): (0.0, None)}  # state: the last two letters read, the letter just read; value: cost, (way here, letter)
        for c in token:
            step: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            ways = [(c, 0.0)] if c.isalpha() else [(c, KEEP_SIGN_COST)] if c.isdigit() else []
            ways += [(x, SWAP_COST) for x in LOOKALIKES.get(c, "")]
            drop = DROP_COST if not c.isalnum() else None
            for (context, last), (cost, read) in best.items():
                for x, price in ways:
                    to = (context[1] + x, x)
                    total = cost + price + self._price(context, x)
                    if to not in step or total < step[to][0]:
                        step[to] = (total, (read, x))
                    if x == last:  # a stretched letter
                        stay = (context, last)
                        if stay not in step or cost + price + REPEAT_COST < step[stay][0]:
                            step[stay] = (cost + price + REPEAT_COST, read)
                if drop is not None:
                    stay = (context, last)
                    if stay not in step or cost + drop < step[stay][0]:
                        step[stay] = (cost + drop, read)
            best = step or best
        way = min(best.items(), key=lambda x: x[1][0] + self._price(x[0][0], "~"))[1][1]
        letters = []
        while way:
            way, x = way
            letters.append(x)
        return "".join(reversed(letters))

    def evidence(self, word: str) -> list[tuple[str, float]]:
        got = self.words.get(word)
        if got is not None:
            return [(word, got)]
        return [(word[:n], self.starts[word[:n]]) for n in BEGINNINGS if word[:n] in self.starts][-1:]

    def spaced(self, run: str) -> list[tuple[str, float]]:
        """Evidence in a run of spaced letters: neighbours may be single letters too, so words are looked for inside the reading."""
        read = self.decode(run)
        found = [(w, e) for w, e in self.words.items() if len(w) >= 4 and w in read]
        found = found or [(w, e) for w, e in self.starts.items() if len(w) >= 5 and w in read]
        if found or len(read) > 5:
            return found
        # A word of three letters counts only as the whole reading, but for a single letter at either end.
        return [(w, self.words[w]) for w in dict.fromkeys((read, read[1:], read[:-1], read[1:-1])) if len(w) == 3 and w in self.words]

    def token(self, token: str) -> list[tuple[str, float]]:
        """Evidence in a lower-case token as written, else as restored."""
        plain = token.strip(EDGE)
        found = self.evidence(plain)
        if found or len(token) < 3 or token.isalpha() and not REPEATED.search(token):
            return found
        inner = token.strip(".,;:?\"'")
        if inner.isalpha() and not REPEATED.search(inner) or not any(c.isalpha() for c in inner):
            return found
        found = self.evidence(self.decode(inner))
        if inner.isalpha() and not STRETCHED.search(inner):  # ordinary words double letters too: no short beginnings
            return [(w, e) for w, e in found if w in self.words or len(w) >= 5]
        return found

    def restore(self, text: str) -> str:
        """The text with its obfuscated tokens decoded."""
        text = SPACED.sub(lambda m: self.decode(m[0].lower()) if self.spaced(m[0].lower()) else m[0], text)
        return re.sub(r"\S+", lambda m: m[0] if not self.token(m[0].lower()) or self.evidence(m[0].lower().strip(EDGE)) else self.decode(m[0].lower().strip(".,;:?\"'")), text)

    def score(self, text: str, memo: dict) -> float:
        lower, found = text.lower(), {}
        for t in set(lower.split()):
            got = memo.get(t)
            if got is None:
                got = self.token(t) or ()  # one empty tuple for all tokens without evidence
                if len(memo) >= MEMO:
                    memo.clear()
                if len(t) <= 48:
                    memo[t] = got
            if got:
                found.update(got)
        for m in SPACED.finditer(lower):
            run = m[0]
            whole = memo.get(run)
            if whole is None:
                whole = self.spaced(run)
                if len(run) <= 164:
                    memo[run] = whole
            found.update(whole)
        marks = sorted(found.values(), reverse=True)
        evidence = marks[0] + 0.5 * sum(marks[1:]) if marks else 0.0
        return 1 / (1 + math.exp(-min(35.0, evidence - 2.2)))


class _Toxic:
    """What some toxic documents add to the counts of words ("w") and beginnings ("s")."""

    def __init__(self) -> None:
        self.held: dict[str, Counter] = {"w": Counter(), "s": Counter()}  # documents that hold it
        self.tokens: Counter = Counter()
        self.around: dict[str, dict[str, set]] = {"w": defaultdict(set), "s": defaultdict(set)}  # up to MOST_CONTEXTS neighbourhoods

    def add(self, tokens: list[str]) -> None:
        words = set(tokens)
        self.tokens.update(tokens)
        self.held["w"].update(words)
        self.held["s"].update({t[:n] for n in BEGINNINGS for t in words if len(t) >= n})
        around, around_start = self.around["w"], self.around["s"]
        for before, t, after in zip(["", *tokens], tokens, [*tokens[1:], ""], strict=False):
            for places in (around[t], *(around_start[t[:n]] for n in BEGINNINGS if len(t) >= n)):
                if len(places) < MOST_CONTEXTS:
                    places.add(before + " " + after)

    def rows(self) -> list[tuple]:
        found = []
        for kind, held in self.held.items():
            for f, n in held.items():
                places = self.around[kind][f]
                many = len(places) >= MOST_CONTEXTS  # enough by themselves
                found.append((kind, f, n, self.tokens[f] if kind == "w" else 0, many, None if many else list(places)))
        return found


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "key", "yes", "n", "many", "places"])


def _count(batches):
    """Trigrams ("t") of all documents, words and beginnings of the toxic ones; rows of a key sum up."""
    toxic, met, trigrams = _Toxic(), Counter(), Counter()
    for batch in batches:
        for y, text in zip(batch.column("y"), batch.column("text"), strict=True):
            tokens = tokens_of(text.as_py() or "")
            met.update(tokens)
            if y.as_py():
                toxic.add(tokens)
            if len(toxic.held["w"]) + len(toxic.held["s"]) >= COUNTED:
                yield _batch(toxic.rows())
                toxic = _Toxic()
            if len(met) >= COUNTED:
                trigrams.update(trigrams_of(met))
                met = Counter()
    trigrams.update(trigrams_of(met))
    yield _batch(toxic.rows() + [("t", g, 0, n, False, None) for g, n in trigrams.items()])


def _others(marks):
    """Documents that are not toxic and hold a mark."""

    def run(batches):
        words, starts = (marks.value[kind].keys() for kind in "ws")
        held: dict[str, Counter] = {"w": Counter(), "s": Counter()}
        for batch in batches:
            for text in batch.column("text"):
                tokens = set(tokens_of(text.as_py() or ""))
                held["w"].update(tokens & words)
                held["s"].update({t[:n] for n in BEGINNINGS for t in tokens} & starts)
        rows = [(kind, f, n) for kind in "ws" for f, n in held[kind].items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "key", "no"])

    return trimmed(run)


def fit(known: DataFrame, least_contexts: int | None = None, least_ratio: float = LEAST_RATIO) -> Model:
    """The model of all (y, text) rows, equal to ``Model`` over them: counts are taken in every task and summed by key.

    Words and beginnings with enough neighbourhoods in toxic documents, and enough of them to reach
    the ratio if no other document held them, are sought in the others. The driver gets these, a part
    of the vocabulary, and the character trigrams, but no documents. Neighbourhoods are told apart
    up to MOST_CONTEXTS in a task, where they suffice, so a row of the sums holds fewer a task.
    """
    known = materialize(known.select("y", "text"), "labelled")
    size = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    least = least_contexts or least_contexts_of(size.get(1, 0))
    if least > MOST_CONTEXTS:
        raise ValueError(f"least_contexts is {MOST_CONTEXTS} at most")
    if not size:
        return Model([])
    parts = known.mapInArrow(trimmed(_count), "kind string, key string, yes long, n long, many boolean, places array<string>")
    sums = parts.groupBy("kind", "key").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n"), F.max("many").alias("many"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    sums = materialize(sums, "toxic_counts")
    trigrams = Counter({r["key"]: r["n"] for r in sums.where("kind = 't'").select("key", "n").collect()})
    if min(size.get(0, 0), size.get(1, 0)) == 0:
        return Model.of({}, {}, trigrams)

    def ratio(yes, no):
        return ((yes + 0.5) / (size[1] + 1)) / ((no + 0.5) / (size[0] + 1))

    able = sums.where((F.col("many") | (F.col("places") >= least)) & (ratio(F.col("yes"), F.lit(0)) >= least_ratio))
    beginnings = F.explode(F.array(*(F.when(F.char_length("key") >= n, F.substring("key", 1, n)) for n in BEGINNINGS)))
    shared = sums.where("kind = 'w'").select(beginnings.alias("key"), "n").where("key IS NOT NULL").groupBy("key").agg(F.count("n").alias("words"), F.max("n").alias("top"), F.sum("n").alias("total"))
    starts = able.where("kind = 's'").join(shared.where("words >= 4 AND top < 0.5 * total"), "key", "left_semi")
    held = [{r["key"]: r["yes"] for r in sorted(x.select("key", "yes").collect())} for x in (able.where("kind = 'w'"), starts)]
    shared_marks = known.sparkSession.sparkContext.broadcast(dict(zip("ws", held, strict=True)))
    others = known.where("y = 0").select("text").mapInArrow(_others(shared_marks), "kind string, key string, no long").groupBy("kind", "key").agg(F.sum("no").alias("no"))
    no = Counter({(r["kind"], r["key"]): r["no"] for r in others.collect()})
    found = [{f: math.log(r) for f, yes in some.items() if (r := ratio(yes, no[kind, f])) >= least_ratio} for kind, some in zip("ws", held, strict=True)]
    return Model.of(*found, trigrams)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", with_text: bool = True) -> DataFrame:
    """All columns of docs (without ``with_text`` not the text) and ``name``, the probability of label 1."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    others = [c for c in docs.columns if c != name and (with_text or c != text)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memo: dict = {}
        for batch in batches:
            p = [shared.value.score(x.as_py() or "", memo) for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(p, pa.float64())], names=[*others, name])

    return docs.select(*others, *([] if with_text else [text])).mapInArrow(trimmed(run), StructType([*(docs.schema[c] for c in others), StructField(name, DoubleType())]))
