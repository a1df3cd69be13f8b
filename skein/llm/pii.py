"""Operator 10: personal data by fixed patterns and a linear-chain conditional random field.

Four kinds follow fixed patterns: email, ip, card and phone. The field adds names, ids
and secrets that show by their surroundings. Its tokens are words and single signs, its
features a token's shape, length, share of digits, first and last letters, whether it
announces a span, whether white space stands before it, what the nearest announcing word
before it announces, and the shapes and announcements around it. It is trained by the likelihood from sentences that a seeded rule writes from
the small labelled table below and from invented prose that holds nothing. Every token of
every text is scored and decoded by Viterbi in numpy: texts are dealt into runs of RUN
tokens, the best ways through all runs are found side by side for each tag at their ends,
and the runs of a text are then joined, which gives the best way through the whole text.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Remembering, id_and_text, per_document, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "id", "secret")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
TAGS = ("out", *ADDED)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT, NOT_DIGIT, DOTTED = re.compile(r"[0-9]"), re.compile(r"[^0-9]"), re.compile(r"[0-9]\.[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain; each @ is looked at once, so long runs stay linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the fixed patterns, leftmost and not overlapping within a kind."""
    out = [(a, b, "email") for a, b in emails(text)]
    if DIGIT.search(text):
        if DOTTED.search(text):
            out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


#: Words that announce a span.
CUES = {
    "title": "mr mrs ms dr prof herr frau monsieur madame mme señor señora sra".split(),
    "name": "name names named contact nombre nom patient signed attn regards".split(),
    "id": "ssn passport iban account konto kontonummer dni nif siren cuenta ausweis reisepass pasaporte passeport".split(),
    "secret": "token password passwd secret apikey key pwd passwort contraseña credential bearer".split(),
    "between": "is ist es est number no nr at von de of api access".split(),
}
CUE_OF = {w: k for k, ws in CUES.items() for w in ws}
WORDS = re.compile(r"[^\W_]+|[^\w\s]|_")
PARTS = re.compile(r"\s+|[^\W_]+|[^\w\s]|_")
#: Tokens of a run; characters of texts that are decoded together (a longer text alone).
RUN, TOGETHER = 64, 1_000_000

#: Labelled table: sentences whose braces are filled by the rules below; sentences without braces hold nothing.
SENTENCES = """
the report was sent to Mr. {name} yesterday .
please ask Mrs. {name} about it
Dr. {name} wrote the note and left
we met Herr {name} in the hall
Frau {name} kam mit der Tochter
Madame {name} est venue hier
Señor {name} y su hermano
Prof. {name} and the others agreed
contact {name} at the office
Contact: {name} , second floor
for more please contact {name} .
my name is {name} and I live here
Name: {name}
name = {name} ;
the name of the patient is {name} , aged 40
mein Name ist {name} und ich komme
mon nom est {name} , merci
mi nombre es {name} y vivo
signed, {name}
attn {name} , third floor
regards, {name}
Regards {name} , manager
patient {name} was seen at noon
the patient {name} left early
contact person: {name}
contact person is {name} ,
Ms. {name} called again
please call Mr. {name} today
Signed: {name}
signed by {name} on Monday
attn: {name}
Attn {name}
nombre: {name} , edad 30
nombre {name} y
Name des Kunden: {name}
nom : {name} ,
Nom du client : {name}
her name was {name} , they said
names: {name} and others
Mme {name} a dit
Sra. {name} no vino
SSN: {ssn}
SSN:{ssn}
ssn {ssn} is on file
my ssn is {ssn} and more
passport {passport} expires soon
passport number {passport} was lost
Passport: {passport}
Reisepass {passport} bitte
IBAN {iban} please
iban: {iban}
account {account} was closed
account number: {account} is open
account no {account} , thanks
Konto {account} bei der Bank
DNI {dni} del cliente
cuenta {account} cerrada
NIF: {dni}
token = "{key}" and then
token={key}
TOKEN = "{key}" !! AND
access token: {key} the end
password : {password} was changed
password={password}
password = {password} ok
the password is {password} , keep it
Passwort: {password} bitte
secret = "{key}" here
secret={password}
api_key = "{key}" for tests
api_key: {key}
API key {key} leaked
pwd : {password} do not share
pwd={password};
bearer {key} in the header
the token = "{key}" of the day
THE TOKEN = "{key}" OF THE DAY
words | token = "{key}" | words
some*** token = "{key}" more%%%
Token: {key}
TOKEN={key}
"token": "{key}"
"password": "{password}",
Password: {password}
PASSWORD = {password}
the secret is {password} .
secret: {key}
secret key = {key}
"api_key": "{key}"
credential {password} was sent
pwd: {password}
the dr was late and the day was long
Dr. Who The First was a show of old
It was a mr of old times
Mr. And The Others came late
Dr. Who The Second was dull
Prof. What The Long Day brought
The Name was there The Other was not
the name of the house is old and the street is long
in the name of the law he said so
Name and Place are words in a table
contact us at the office or write a note
contact the support for more
please contact your bank today
a contact was made The Next Day
la clave de la casa y el nombre de la calle
der Name der Stadt ist alt
le nom de la ville est beau
the account number was closed for the day
on account of the rain we stayed
the account of the day was long and 12 people came
passport control is on the left
a passport is needed in 1999 and after
das Konto ist leer und die Bank zu
the secret of the house was old
the password was lost and the token too
a token of the past is here
the key to the door is on the table
key words and key points , 3 of 5
no secret at all : they knew
token by token they read it
password must have 8 signs or more
commit {key} was fine
build {key} passed in the night
sha {key} of the file
the number {account} for the day
call 555-1234 or 555-9876 after 10.30
the version 2.0 of it and 3.1.4
in 1999 there were 250 of them and 12 more
item 12-34-56 in the list
| it | was | a | table | of | words |
!!! SALE !!! *** THE BIG SALE $$$ OF THE YEAR ###
"""
GIVEN = "Anna John Maria Peter Clara Hugo Ines Karl Laura Marc Nora Otto Paula Ralf Sofia Tomas Ursula Victor Wanda Yann Elena Bruno Carmen Dieter Emma Felix Greta Henri Irene Jakob".split()
FAMILY = "Smith Schmidt Dubois Garcia Weber Lopez Miller Moreau Fischer Torres Baker Braun Laurent Navarro Cooper Keller Bernard Ortega Turner Vogel Girard Molina Parker Krause Lefevre Serrano Walker Huber Rousseau Vidal".split()
PLAIN_WORDS = "dragon winter coffee monkey sunset garden rocket purple silver tiger hunter shadow".split()
TAG_OF = {"name": "name", "ssn": "id", "passport": "id", "iban": "id", "account": "id", "dni": "id", "key": "secret", "password": "secret"}


def filling(slot: str, rng: random.Random, given: list[str], family: list[str]) -> str:
    """A value for a brace of the table, invented by rule."""

    def some(signs: str, n: int) -> str:
        return "".join(rng.choice(signs) for _ in range(n))

    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    if slot == "name":
        return rng.choice(["{0} {1}", "{0} {1}", "{1}", "{0} {2}. {1}"]).format(rng.choice(given), rng.choice(family), rng.choice(upper))
    if slot == "password":
        word = rng.choice(PLAIN_WORDS)
        leet = word.translate(str.maketrans("aeio", "4310")).capitalize()
        return rng.choice([f"{word}{some(digits, 3)}", leet + some(digits, 1), f"{leet[:3]}-{some(digits, 2)}{leet[3:]}", f"{word}!{some(digits, 2)}", some(lower + upper + digits, 10)])
    if slot == "key":
        kind = rng.randrange(5)
        return [some("0123456789abcdef", rng.choice([32, 40])), some("0123456789ABCDEF", 40), "AKIA" + some(upper + digits, 16), "sk_live_" + some(lower + digits, 24), some(upper + lower + digits, rng.randrange(20, 41))][kind]
    return {"ssn": f"{some(digits, 3)}-{some(digits, 2)}-{some(digits, 4)}", "passport": rng.choice([some(upper, 1) + some(digits, 7), some(digits, 9)]), "iban": some(upper, 2) + some(digits, 20), "account": some(digits, rng.randrange(8, 13)), "dni": some(digits, 8) + some(upper, 1)}[slot]


def sentences(held_out: bool, each: int = 6, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with their spans. Every third sentence of the table and every third name are held out.

    Keys and numbers without an announcing word before them (commit, build, sha, number) are no span.
    """
    rng, out = random.Random(seed + held_out), []
    names = [[x for i, x in enumerate(xs) if (i % 3 == 2) == held_out] for xs in (GIVEN, FAMILY)]
    for n, line in enumerate(SENTENCES.strip().splitlines()):
        if (n % 3 == 2) != held_out:
            continue
        for _ in range(each):
            text, spans = "", []
            for i, part in enumerate(re.split(r"[{}]", line)):
                if i % 2:
                    part_ = filling(part, rng, *names)
                    if line.split()[0] not in ("commit", "build", "sha") and not line.startswith("the number"):
                        spans.append((len(text), len(text) + len(part_), TAG_OF[part]))
                    part = part_
                text += part
            out.append((text, spans))
    return out


SYLLABLES = "an er on th re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ma li ro ne co".split()
FUNCTION_WORDS = "the of and to in that was for with on der die und das nicht mit les des une dans que los las por una con".split()


def prose(n: int = 160, seed: int = 12) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Invented texts without spans: sentences that begin in capitals, numbers and signs."""
    rng, out = random.Random(seed), []

    def word() -> str:
        return rng.choice(FUNCTION_WORDS) if rng.random() < 0.3 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5)))

    for _ in range(n):
        text, top = "", rng.random() < 0.5
        for _ in range(rng.randrange(5, 11)):
            w = word()
            if top or rng.random() < 0.02:
                w = w.capitalize()
            elif rng.random() < 0.08:
                w = rng.choice([str(rng.randrange(10 ** rng.randrange(1, 10))), w.upper(), w + str(rng.randrange(100))])
            top = rng.random() < 0.25
            text += w + (rng.choice([". ", ".\n", ".", "! ", "? ", ": ", "\n"]) if top else rng.choice([", ", "; ", " - ", "' ", '" ', " = ", "/", "_", "* ", "| "]) if rng.random() < 0.15 else " ")
        out.append((text.strip(), []))
    return out


def head(word: str, low: str) -> tuple[str, str, int, int]:
    """A token's shape, what it announces, class of length and quarter of digits."""
    n = len(word)
    digits = 0 if word.isalpha() else sum(c.isdigit() for c in word)
    if digits == n:
        shape = "digits"
    elif digits:
        shape = "hex" if n >= 12 and all(c in "0123456789abcdef" for c in low) else "mixed"
    elif not word[0].isalnum():
        shape = "sign" + word if word in "=:\"'-._,;!/" else "sign"
    else:
        shape = "lower" if word.islower() else "upper" if n > 1 and word.isupper() else "title" if n == 1 or word[1:].islower() else "odd"
    return shape, CUE_OF.get(low, ""), bisect_left((1, 2, 4, 7, 9, 15, 31), n), min(3, 4 * digits // n)


def head_features(shape: str, cue: str, long: int, quarter: int) -> tuple[str, ...]:
    """Features of a head; the first two also describe the token to its neighbours."""
    return shape, f"cue={cue}", f"length={long}", f"digits={quarter}", f"{shape}{long}"


def end_features(word: str, low: str) -> tuple[str, str]:
    return (f"first={low[:2]}", f"last={low[-2:]}") if word.isalpha() else ("first=", "last=")


def word_features(word: str) -> tuple[str, ...]:
    low = word.lower()
    return (*head_features(*head(word, low)), *end_features(word, low))


PLACES = (-3, -2, -1, 1, 2)
#: What an announcing word announces; tokens after it that are told so.
KINDS = ("", "title", "name", "id", "secret")
KIND_OF = {w: KINDS.index(k) for w, k in CUE_OF.items() if k in KINDS}
AFTER = 6


def opening(word: str) -> int:
    return KIND_OF.get(word.lower(), 0)


def announced(kinds: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For each token the kind of the nearest announcing word among the AFTER tokens before it in its text, 0 for none."""
    at = np.arange(len(kinds))
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(kinds > 0, at, -1))[:-1]])
    near = (last >= 0) & (at - last <= AFTER) & (text_of[last] == text_of)
    return np.where(near, kinds[last], 0)


@dataclass
class Field:
    """Weights (features, tags), numbers of the features, and scores of steps from tag to tag."""

    weights: np.ndarray
    number: dict[str, int]
    step: np.ndarray
    own: Remembering = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.own = Remembering(self.own_numbers, 50_000, 64)
        k = len(TAGS)
        self.heads, self.head_rows = {None: 0}, [(np.zeros(k), np.zeros((len(PLACES), k)), 0)]
        self.spot = Remembering(self.spot_of, 50_000, 64)

    def __getstate__(self):
        return {"weights": self.weights, "number": self.number, "step": self.step}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def own_numbers(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Numbers of a word's own features (0: unknown), and of what it says to its neighbours at each place."""
        own = word_features(word)
        return tuple(self.number.get(f, 0) for f in own), tuple(self.number.get(f"{p}:{f}", 0) for p in PLACES for f in own[:2])

    def spot_of(self, word: str) -> tuple[int, int, int]:
        """Row of the word's head (0: white space), numbers of its two end features."""
        if word.isspace():
            return 0, 0, 0
        low = word.lower()
        of = head(word, low)
        row = self.heads.get(of)
        if row is None:
            own = head_features(*of)
            said = [[self.number.get(f"{p}:{f}", 0) for f in own[:2]] for p in PLACES]
            row = self.heads[of] = len(self.head_rows)
            self.head_rows.append((self.weights[[self.number.get(f, 0) for f in own]].sum(axis=0), self.weights[said].sum(axis=1), KIND_OF.get(low, 0)))
        first, last = end_features(word, low)
        return row, self.number.get(first, 0), self.number.get(last, 0)

    def features(self, text: str, places: list[tuple[int, int]]) -> np.ndarray:
        """(tokens, features) numbers of a stretch's tokens."""
        known = [self.own[text[a:b]] for a, b in places]
        own = np.array([k[0] for k in known])
        said = np.array([k[1] for k in known])
        out, n = [own], len(places)
        for i, p in enumerate(PLACES):
            beside = np.full((n, 2), self.number["edge"])
            if abs(p) < n:
                beside[max(0, -p) : n - max(0, p)] = said[max(0, p) : n + min(0, p), 2 * i : 2 * i + 2]
            out.append(beside)
        glued = [self.number["glued"] if i and places[i - 1][1] == a else self.number["apart"] for i, (a, _) in enumerate(places)]
        out.append(np.array(glued)[:, None])
        kinds = np.array([opening(text[a:b]) for a, b in places])
        out.append(np.array([self.number[f"after={KINDS[k]}"] for k in announced(kinds, np.zeros(n, dtype=int))])[:, None])
        return np.concatenate(out, axis=1)


def train(rounds: int = 150, rate: float = 0.3, decay: float = 0.06) -> Field:
    """Maximum likelihood of the sentences that are not held out and of prose(), with a quadratic penalty, by full gradients (Adagrad) over all sentences at once."""
    data = sentences(False) + prose()
    number: dict[str, int] = {"": 0, "edge": 1, "glued": 2, "apart": 3, **{f"after={k}": 4 + i for i, k in enumerate(KINDS)}}
    for text, _ in sentences(False):  # prose adds no features, so that no rare ending stands for all of it
        for w in set(WORDS.findall(text)):
            own = word_features(w)
            for f in (*own, *(f"{p}:{f}" for p in PLACES for f in own[:2])):
                number.setdefault(f, len(number))
    k = len(TAGS)
    f = Field(np.zeros((len(number), k)), number, np.zeros((k, k)))
    cut_ = [([m.span() for m in WORDS.finditer(text)], spans) for text, spans in data]
    longest = max(len(p) for p, _ in cut_)
    lengths = np.array([len(p) for p, _ in cut_])
    ids = np.zeros((len(data), longest, 19), dtype=np.int64)
    gold = np.zeros((len(data), longest), dtype=np.int64)
    for i, ((text, _), (places, spans)) in enumerate(zip(data, cut_)):
        ids[i, : len(places)] = f.features(text, places)
        for a, b, tag in spans:
            gold[i, : len(places)][[a <= x < b for x, _ in places]] = TAGS.index(tag)
    live = np.arange(longest)[None, :] < lengths[:, None]
    past = [np.full(f.weights.shape, 1e-6), np.full(f.step.shape, 1e-6)]
    rows = np.arange(len(data))
    for _ in range(rounds):
        u = f.weights[ids].sum(axis=2)
        ahead, back = np.zeros(u.shape), np.zeros(u.shape)
        ahead[:, 0] = u[:, 0]
        for t in range(1, longest):
            ahead[:, t] = u[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + f.step, axis=1)
        for t in range(longest - 2, -1, -1):
            further = np.logaddexp.reduce(f.step[None] + (u[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where((t + 1 < lengths)[:, None], further, 0.0)
        total = np.logaddexp.reduce(ahead[rows, lengths - 1], axis=1)
        p = np.exp(ahead + back - total[:, None, None])
        p[rows[:, None], np.arange(longest)[None, :], gold] -= 1
        p[~live] = 0
        grads = [decay * f.weights, decay * f.step]
        np.add.at(grads[0], ids, np.broadcast_to(p[:, :, None, :], (*ids.shape, k)))
        for t in range(1, longest):
            on = t < lengths
            pair = np.exp(ahead[on, t - 1, :, None] + f.step + (u[on, t] + back[on, t])[:, None, :] - total[on, None, None])
            grads[1] += pair.sum(axis=0)
            np.add.at(grads[1], (gold[on, t - 1], gold[on, t]), -1.0)
        for value, g, h in zip((f.weights, f.step), grads, past):
            h += g * g
            value -= rate * g / np.sqrt(h)
        f.weights[0] = 0
    return f


@lru_cache(maxsize=1)
def trained() -> Field:
    return train()


def viterbi_in_runs(u: np.ndarray, sizes: np.ndarray, step: np.ndarray, run: int = RUN) -> np.ndarray:
    """Best tags of several texts. u: (tags, tokens) scores of all texts' tokens, one text after another; sizes: their numbers of tokens, none 0.

    Runs of tokens are settled side by side. First the best score from each tag at a run's
    first token to each at its last; from these, run by run, the best score that comes into
    each run; with that the best way back from each tag at its end; at last, from the end
    of each text, the tag that each run ends in.
    """
    k, texts = len(u), len(sizes)
    many = -(-sizes // run)
    text_of = np.repeat(np.arange(texts), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = np.repeat(np.cumsum(sizes) - sizes, many) + nth * run
    size = np.minimum(run, np.repeat(sizes, many) - nth * run)
    order = np.argsort(-size, kind="stable")
    start, size, text_of, nth = start[order], size[order], text_of[order], nth[order]
    n, longest = len(start), size[0]
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest + 1)]  # runs of more than t tokens come first
    across = np.full((k, k, n), -np.inf)
    for i in range(k):
        across[i, i] = u[i, start]
    for t in range(1, longest):
        m, new = live[t], u[:, start[: live[t]] + t]
        old = across[:, :, :m].copy()
        for j in range(k):
            best = old[:, 0] + step[0, j]
            for i in range(1, k):
                np.maximum(best, old[:, i] + step[i, j], out=best)
            across[:, j, :m] = best + new[j]
    by_place = [np.flatnonzero(nth == r) for r in range(many.max())] if many.max() < 64 else np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1])
    into, out = np.zeros((k, n)), np.zeros((k, texts))
    for r, at in enumerate(by_place):
        if r:
            into[:, at] = (out[:, None, text_of[at]] + step[:, :, None]).max(axis=0)
        out[:, text_of[at]] = (into[:, None, at] + across[:, :, at]).max(axis=0)
    back = np.zeros((longest, k, n), dtype=np.int8)
    best = into + u[:, start]
    for t in range(1, longest):
        m, new = live[t], u[:, start[: live[t]] + t]
        old = best[:, :m].copy()
        for j in range(k):
            top, come = old[0] + step[0, j], np.zeros(m, dtype=np.int8)
            for i in range(1, k):
                other = old[i] + step[i, j]
                more = other > top
                come[more] = i
                np.maximum(top, other, out=top)
            best[j, :m], back[t, j, :m] = top + new[j], come
    ways = np.zeros((longest, k, n), dtype=np.int8)
    now = np.repeat(np.arange(k, dtype=np.int8)[:, None], n, axis=1)
    for t in range(longest - 1, -1, -1):
        m = live[t]
        ways[t, :, :m] = now[:, :m]
        if t:
            now[:, :m] = np.take_along_axis(back[t, :, :m], now[:, :m].astype(np.intp), axis=0)
    tags, end = np.zeros(u.shape[1], dtype=np.int8), out.argmax(axis=0)
    begins = np.zeros(texts, dtype=np.int8)
    for r in range(len(by_place) - 1, -1, -1):
        at = by_place[r]
        of = text_of[at]
        last = r == many[of] - 1
        ends_in = np.where(last, end[of], begins[of])
        chosen = ways[:, ends_in, at]
        for t in range(longest):
            on = size[at] > t
            tags[start[at[on]] + t] = chosen[t, on]
        if r:
            first = chosen[0]
            before = by_place[r - 1]
            score = np.zeros((k, texts))
            score[:, text_of[before]] = best[:, before]
            begins[of] = (score[:, of] + step[:, first]).argmax(axis=0)
    return tags


def viterbi(u: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """viterbi_in_runs() of texts padded to one length, u: (texts, longest, tags), each of at least one token."""
    live = np.arange(u.shape[1])[None, :] < lengths[:, None]
    tags = np.zeros(live.shape, dtype=np.int8)
    tags[live] = viterbi_in_runs(np.ascontiguousarray(u[live].T), lengths, step)
    return tags


def tagged(f: Field, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans that the field finds in each text, from all of its tokens. Texts are decoded together up to TOGETHER characters."""
    out: list[list[tuple[int, int, str]]] = []
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > TOGETHER:
            out += _tagged(f, some)
            some, size = [], 0
        some.append(text)
        size += len(text)
    return out + (_tagged(f, some) if some else [])


def _tagged(f: Field, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    number: dict[str, int] = {}
    ids, sizes, lengths = [], [], []
    for text in texts:
        parts = PARTS.findall(text)
        ids += [number.setdefault(w, len(number)) for w in parts]
        lengths += map(len, parts)
        sizes.append(len(parts))
    spots = np.array([f.spot[w] for w in number], dtype=np.intp).reshape(-1, 3)
    own, said, kinds = (np.array(x) for x in zip(*f.head_rows))
    own = own[spots[:, 0]] + f.weights[spots[:, 1]] + f.weights[spots[:, 2]]
    ids, lengths = np.array(ids, dtype=np.intp), np.array(lengths, dtype=np.int64)
    text_of, ends = np.repeat(np.arange(len(texts)), sizes), np.cumsum(lengths)
    token = spots[ids, 0] > 0
    if not token.any():
        return out
    glued = np.zeros(len(ids), dtype=bool)
    glued[1:] = token[:-1] & (text_of[1:] == text_of[:-1])
    glued, ids, text_of, ends, lengths = glued[token], ids[token], text_of[token], ends[token], lengths[token]
    u = own[ids] + np.where(glued[:, None], f.weights[f.number["glued"]], f.weights[f.number["apart"]])
    heads = spots[ids, 0]
    u += f.weights[[f.number[f"after={k}"] for k in KINDS]][announced(kinds[heads], text_of)]
    edge = 2 * f.weights[f.number["edge"]]
    for i, p in enumerate(PLACES):
        at = np.arange(len(ids)) + p
        inside = (at >= 0) & (at < len(ids))
        at = np.clip(at, 0, len(ids) - 1)
        inside &= text_of[at] == text_of
        u += np.where(inside[:, None], said[heads[at], i], edge)
    sizes = np.bincount(text_of)
    sizes = sizes[sizes > 0]
    tags = viterbi_in_runs(np.ascontiguousarray(u.T), sizes, f.step)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    last = -2
    for t in np.flatnonzero(tags):
        n, tag = int(text_of[t]), TAGS[tags[t]]
        b = int(ends[t] - begin[n])
        a = b - int(lengths[t])
        if last == t - 1 and out[n] and out[n][-1][2] == tag:
            out[n][-1] = (out[n][-1][0], b, tag)
        else:
            out[n].append((a, b, tag))
        last = t
    return out


def precision_and_recall(held_out: bool = True) -> dict[str, tuple[float, float]]:
    """(precision, recall) of whole spans for each added kind, on the sentences of the table that are held out or not."""
    data = sentences(held_out)
    found = tagged(trained(), [t for t, _ in data])
    out = {}
    for kind in ADDED:
        want = {(i, *s) for i, (_, spans) in enumerate(data) for s in spans if s[2] == kind}
        got = {(i, *s) for i, spans in enumerate(found) for s in spans if s[2] == kind}
        out[kind] = (len(want & got) / max(1, len(got)), len(want & got) / max(1, len(want)))
    return out


def all_spans(texts: list[str], f: Field) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base spans, all spans) of each text; what the field finds over a base span is left to the base."""
    out = []
    for text, added in zip(texts, tagged(f, texts)):
        base = base_spans(text)
        free = [s for s in added if not any(a < s[1] and s[0] < b for a, b, _ in base)]
        out.append((base, sorted(base + free, key=lambda s: (s[0], ORDER[s[2]]))))
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, base and spans (arrays of start, end, kind in code points).

    A null or empty text has none. Whole texts are read. Repeated rows and equal texts get
    equal spans; null ids are handled like others. An empty table gives an empty result;
    other columns are not read.
    """
    one, f = "array<struct<start:int, end:int, kind:string>>", trained()

    def rows(ids, texts):
        found = [[[dict(zip(("start", "end", "kind"), s)) for s in part] for part in both] for both in all_spans(texts, f)]
        return {"doc_id": ids, "base": [b for b, _ in found], "spans": [s for _, s in found]}

    return per_document(id_and_text(docs, id_col, text_col), rows, f"doc_id long, base {one}, spans {one}")


def redacted(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with every span of text_col replaced by its kind in brackets and count_col, if there is one, set to the new length.

    Overlapping spans are replaced together, under the kind of the first. Null texts stay
    null. Other columns are passed on as they are.
    """
    f = trained()

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 256):
            some = texts.iloc[at : at + 256]
            for text, spans in zip(some, all_spans([t if isinstance(t, str) else "" for t in some], f)):
                parts, done = [], 0
                for a, b, kind in spans[1]:
                    if a >= done:
                        parts += [text[done:a], f"[{kind}]"]
                    done = max(done, b)
                out.append("".join([*parts, text[done:]]) if spans[1] else text)
        return pd.Series(out, dtype=object)

    out = docs.withColumn(text_col, masked(F.col(text_col)))
    return out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType)) if count_col in docs.columns else out


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
