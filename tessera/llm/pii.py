"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what patterns miss.

The field is trained from TABLE, a small labelled table, and decoded by Viterbi over all sentences of a batch side by
side, long ones in blocks whose best paths are joined exactly. It adds spans of kinds `secret` (credentials) and `name`
where they do not meet spans of the patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, beside, col, documents, span_hashes, texts_of, words

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "name")
KINDS = (*BASE, *ADDED)

# --- patterns -------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins: what fails from there fails from its other digits too
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the @ signs: the local part is the run before the sign, from the last match on."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if (m := _DIGIT.search(text)) is not None:
        first = m.start()
        for m in _IP.finditer(text, first):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text, first):
            if 12 <= m.end() - m.start() <= 40 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the labelled table: [kind:...] marks a span --------------------------------------------------------------------

TABLE = """
the service reads token = "[secret:9f86d081884c7d659a2feaa0c55ad015a3bf4f1b]" from its settings
token = "[secret:2c26b46b68ffc68ff99b453c1d30413413422d70]"
un token = "[secret:0cc175b9c0f1b6a831c399e269772661aabbccdd]" dans le texte
api_key = "[secret:e4d909c290d0fb1ca068ffaddf22cbd0e4d909c2]" and nothing more
the api_key: [secret:sk9fj2Kd83hfQpZ71mXs02LbT55vNcRy] was pasted here
password: [secret:hunter2Xy77qq] and then the rest
his password = "[secret:Tr0ub4dor3xQ]" on the wall
secret = "[secret:a94a8fe5ccb19ba61c4c0873d391e987982fbbd3]" was found
auth_token = "[secret:b6589fc6ab0dc82cf12099d1c2d40ab994e8410c]" in the code
und token = "[secret:356a192b7913b04c54574d18c28d46e6395428ab]" in der datei
el token = "[secret:da4b9237bacccdf19c0760cab7aec4a8359010b0]" de la lista
my name is [name:Anna Keller] and the rest follows
dear [name:Tom Baker], thank you for the letter
signed by [name:Maria Lopez] on the first page
mr [name:John Carter] called the office
mrs [name:Emma Stone] wrote it down
contact: [name:Paul Weber] at the desk
je m'appelle [name:Claire Dubois] et le reste
mein name ist [name:Hans Gruber] und der rest
me llamo [name:Carlos Ruiz] y lo demas
name: [name:Julia Roth] was written there
the year 1999 and the price 1234 or 12.50 for all
version 2.0.1 of the code and 10 of 200 parts
the token was there and the key is here
a password is needed and the secret stays with the name
the contact of the name and dear friends of the house
an order 4716 2341 8899 0012 came with 192.168.0.1 and more
call +1 (555) 555-0123 or write to someone.12@mail.example.com today
4929123412341234 stood in the line and 10.0.0.7 too
token of the order = the name of that
la clave de la casa y el nombre de la lista
das wort und der name von dem haus
Licensed under CC BY 4.0. All of the text is free.
Copyright 2020 The Authors of the Work. See the License for more.
This work is licensed under the GNU General Public License, version 3.
Creative Commons Attribution License and All Rights Reserved by the Authors
Monday and Tuesday are in January and the City of London is there.
my colleague [name:Peter Novak] will answer your letter on Monday
please ask for [name:Laura Jensen] at the front desk
the patient [name:Robert Miles] was seen on the second of May
yours sincerely, [name:Helen Wright]
regards, [name:David O'Brien] and the whole team
written by [name:Sofia Rossi] for the evening paper
dr [name:Martin Schulz] opened the meeting
mme [name:Isabelle Laurent] a signé la lettre
herr [name:Jürgen Becker] wohnt in der stadt
la señora [name:Lucía Fernández] vive en la calle mayor
name: [name:Oliver Stone Hansen]
customer name: [name:Ingrid Dahl] is waiting for an answer
je suis [name:Pierre Moreau] et je vous écris
soy [name:Miguel Torres] y vivo aquí
aws_secret_access_key = [secret:wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY]
bearer token: [secret:eyJhbGciOiJIUzI1NiJ9eyJzdWIiOiIxMjM0] in the header
export API_TOKEN=[secret:ghp4f8Kd93jfLs02mXq71Zr5TbN6vYcW] before the run
passwort: [secret:Sommer2019xK7] steht auf dem zettel
mot de passe: [secret:Lune77Bleue42] pour le compte
the United Nations met in New York on Tuesday, and South Africa spoke first.
Chapter Two of The Old House was read by the Book Club in Spring.
The Bank of England and the European Union signed the Treaty of Rome.
In January the Ministry of Health and the High Court moved to Main Street.
Die Deutsche Bahn und die Freie Universität Berlin suchen neue Leute.
Le Conseil Européen et la Ville de Paris ont donné leur accord.
El Banco Central y la Universidad de Madrid abren en Septiembre.
The password must have ten letters. A token is lost when the session ends.
the name of the river and the name of the town are the same
and then token = "[secret:5f4dcc3b5aa765d61d8327deb882cf99aa10b7c3]" stood at the end of the line
client_secret: "[secret:Zx81kPq04LmN7vBt2RwY6sHd]", scope: "read"
the old password was [secret:blue7Kettle!92] until last week
my name is [name:Grace Osei] and i live in the north
dear [name:Noah Williams], we have received your order
signed by [name:Elif Demir] and by nobody else
Mr [name:Samuel Boateng] and his wife came late.
Contact: [name:Yuki Tanaka] for all further questions.
The garden was quiet. Birds sang. Nobody came. Then it rained.
Read More. Sign Up. Log In. About Us. Contact Us. Privacy Policy.
Home | News | Sports | Weather | Local Guide | Opinion
Terms Of Service And Cookie Settings
Best Price Guaranteed! Free Shipping! Order Today! Limited Offer!
No No No Yes Yes Yes
Buy Buy Buy Sell Sell Sell
Again and Again and Again
Monday Tuesday Wednesday Thursday Friday Saturday Sunday
Introduction Methods Results Discussion References
Lake Superior, Mount Everest and the Pacific Ocean are on the map.
Red Square lies near the Black Sea Hotel. Old Town Market is open.
Olive Oil, Sea Salt, Black Pepper, Green Beans, Brown Rice
The Quick Start Guide. Chapter One. Table of Contents. List of Figures.
Microsoft Word, Google Maps and Open Office are programs.
World War Two ended. The Cold War began. The Berlin Wall fell.
Summer Sale - Winter Coats - Spring Dresses - Autumn Leaves
Dear Sir or Madam, Dear Customers, Dear Friends of the Museum
Signed copies of Great Expectations are sold at the Corner Shop.
Mr President and Mrs Speaker were asked to sit down.
Name: Date: Place: Order Number: Unit Price:
## Install Guide ** Important Note ** Known Issues
win $$$ now!!! 100% free*** click #here# & there&
a*b + c%d - e|f & g#h <b>bold</b> <i>thin</i>
Stop! Wait! Look! Listen! Go! Now! Here! There!
IMPORTANT NOTICE TO ALL READERS OF THIS PAGE
Guten Morgen Deutschland. Der Rote Faden. Das Alte Haus. Die Neue Zeit.
Haus Garten Auto Reise Kinder Schule Arbeit Freizeit
Der Hund und die Katze schlafen. Die Sonne scheint. Das Wasser ist kalt.
Bonjour Paris. La Belle Époque. Les Trois Mousquetaires. Le Petit Prince.
Une Maison Bleue. Des Fleurs Rouges. La Mer et le Soleil.
Le chat dort. La porte est ouverte. Les enfants jouent dans la rue.
Buenos Días España. La Casa Grande. El Mar Azul. Los Tres Amigos.
El perro duerme. La puerta está abierta. Las calles son largas.
Isola Bella. Roma Antica. Buona Sera. La Dolce Vita.
"""


def _parse(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[(\w+):([^\]]*)\]", line):
        text += line[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), m[1]))
        text += m[2]
        at = m.end()
    return text + line[at:], spans


# --- features -------------------------------------------------------------------------------------------------------

#: Classes of bytes in a shape: upper, lower, digit, and each of these marks by itself, other marks together.
_SHAPE = np.full(256, 3, np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = 0
_SHAPE[ord("a") : ord("z") + 1] = 1
_SHAPE[128:] = 1
_SHAPE[ord("0") : ord("9") + 1] = 2
for _k, _c in enumerate('.,:;"=@_+-'):
    _SHAPE[ord(_c)] = 4 + _k
_WORDLIKE = _SHAPE <= 2
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
#: Words that one lane decodes; a longer sentence is several blocks of this many, of which one path is the best (see decode).
BLOCK = 128
#: Which words' features count, by their distance.
SHAPE_AT, WORD_AT = (-1, 0, 1), (-3, -2, -1, 0, 1)


@dataclass
class Words:
    """Features of the words of a batch. starts, ends: bytes without the marks around the word."""

    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray  # words of each text
    sentence: np.ndarray
    shape: np.ndarray
    size: np.ndarray
    word: np.ndarray


def analyse(texts: list[bytes]) -> Words:
    data, starts, ends, counts = words(texts, lower=False)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, counts, none, none, none, none)
    # the word without marks around it; a word of marks alone stays as it is
    solid = np.append(0, np.cumsum(_WORDLIKE[data]))
    has = solid[ends] > solid[starts]
    at = np.flatnonzero(_WORDLIKE[data])
    first = np.where(has, at[np.minimum(solid[starts], len(at) - 1)] if len(at) else starts, starts)
    last = np.where(has, (at[np.maximum(solid[ends] - 1, 0)] if len(at) else ends) + 1, ends)
    # shapes: the classes of the whole word with runs collapsed, hashed
    kind = _SHAPE[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    upto = np.append(0, np.cumsum(change))
    shape = span_hashes(kind[change], upto[starts], upto[ends])
    digits = np.append(0, np.cumsum(kind == 2))
    many = np.minimum(digits[last] - digits[first], 15) // 4
    size = np.minimum(np.searchsorted([3, 6, 10, 16, 24, 32], last - first), 6) * 4 + many
    lowered = data.copy()
    upper = (data >= 0x41) & (data <= 0x5A)
    lowered[upper] += 0x20
    word = span_hashes(lowered, first, last)
    # a sentence ends with a word that ends so, with the line and with the text
    stops = _ENDS[data[ends - 1]]
    lines = np.append(0, np.cumsum(data == 0x0A))
    stops[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    sentence = np.append(0, np.cumsum(stops)[:-1])
    return Words(first, last, counts, sentence, shape, size, word)


def _tags() -> list[str]:
    return ["O", *(f"{p}-{k}" for k in ADDED for p in "BI")]


@dataclass
class Field:
    """Weights of a linear-chain conditional random field; row 0 of shapes and words is for those not in the table."""

    shapes: np.ndarray
    words: np.ndarray
    emit: list[np.ndarray]
    move: np.ndarray
    begin: np.ndarray

    @staticmethod
    def _look(known: np.ndarray, found: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        return np.where(known[at] == found, at + 1, 0)

    def ids(self, w: Words) -> list[np.ndarray]:
        """For each family of features, the row of every word; the last row where the sentence has no such word."""
        n, out = len(w.shape), []
        for ids, size, offsets in ((self._look(self.shapes, w.shape), len(self.shapes) + 1, SHAPE_AT), (self._look(self.words, w.word), len(self.words) + 1, WORD_AT)):
            for d in offsets:
                x = np.full(n, size)
                if d == 0:
                    x = ids
                elif d < 0:
                    x[-d:] = np.where(w.sentence[-d:] == w.sentence[:d], ids[:d], size)
                else:
                    x[:-d] = np.where(w.sentence[:-d] == w.sentence[d:], ids[d:], size)
                out.append(x)
        same = np.zeros(n, np.int64)
        again = (w.word[1:] == w.word[:-1]) & (w.sentence[1:] == w.sentence[:-1])
        same[1:] += again
        same[:-1] += 2 * again
        return [*out, w.size, same]

    def emissions(self, w: Words) -> np.ndarray:
        total = np.zeros((len(w.shape), self.emit[0].shape[1]), np.float32)
        for rows, weights in zip(self.ids(w), self.emit):
            total += weights[rows]
        return total

    def decode(self, w: Words) -> np.ndarray:
        """The best tags of every sentence: Viterbi over blocks of all sentences side by side, the longest first.

        A sentence of one block is decoded as it is. For a longer one, the best score from each tag before a block to each tag
        at its end comes first; these are joined block by block, which gives the scores that each block begins with. Then
        every block is decoded from those, and the tags at the ends of blocks follow from the last block backwards.
        """
        n = len(w.sentence)
        tags = np.zeros(n, np.int64)
        if not n:
            return tags
        e = self.emissions(w)
        t = e.shape[1]
        opens = np.flatnonzero(np.diff(w.sentence, prepend=-1))
        words_of = np.diff(np.append(opens, n))
        per = -(-words_of // BLOCK)
        nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        begin = np.repeat(opens, per) + nth * BLOCK
        length = np.minimum(BLOCK, np.repeat(words_of, per) - nth * BLOCK)
        first = nth == 0
        start = np.zeros((len(begin), t), np.float32)  # best scores with each tag at a block's first word
        start[first] = e[begin[first]] + self.begin
        came = np.zeros((len(begin), t), np.int8)  # the tag before that word
        several = np.flatnonzero(~first)
        if len(several):
            inner = np.append(~first[1:], False) & ~first  # blocks between two others
            through = self._through(e, begin, inner)
            ends: np.ndarray | None = None
            for k in np.flatnonzero(np.append(~first[1:], False) | ~first).tolist():
                if first[k]:
                    ends = start[k]
                    for j in range(begin[k] + 1, begin[k] + length[k]):
                        ends = (ends[:, None] + self.move).max(axis=0) + e[j]
                    continue
                ends = ends - ends.max()  # a path's score is compared with others of its sentence alone
                paths = ends[:, None] + self.move
                came[k] = paths.argmax(axis=0)
                start[k] = paths.max(axis=0) + e[begin[k]]
                if inner[k]:
                    ends = (ends[:, None] + through[k]).max(axis=0)
        order = np.argsort(-length, kind="stable")
        at, live = begin[order], np.searchsorted(-length[order], -np.arange(BLOCK), side="left")
        most = int(length[order[0]])
        best = start[order]
        back: list[np.ndarray] = []
        for k in range(1, most):
            m = live[k]
            paths = best[:m, :, None] + self.move[None]
            back.append(paths.argmax(axis=1).astype(np.int8))
            best[:m] = paths.max(axis=1) + e[at[:m] + k]
        last = np.zeros(len(begin), np.int64)
        last[order] = best.argmax(axis=1)
        if len(several):
            # for each tag at a block's end, the tag at its first word
            heads = np.repeat(np.arange(t)[None], len(begin), axis=0)
            for k in range(most - 1, 0, -1):
                m = live[k]
                heads[:m] = np.take_along_axis(back[k - 1], heads[:m], axis=1)
            heads = heads[np.argsort(order)]
            for k in several[::-1].tolist():
                last[k - 1] = came[k, heads[k, last[k]]]
        now = last[order]
        for k in range(most - 1, -1, -1):
            m = live[k]
            tags[at[:m] + k] = now[:m]
            if k:
                now[:m] = back[k - 1][np.arange(m), now[:m]]
        return tags

    def _through(self, e: np.ndarray, begin: np.ndarray, blocks: np.ndarray) -> dict[int, np.ndarray]:
        """For each of the blocks (whole ones), the best score from each tag before it to each tag at its end."""
        which = np.flatnonzero(blocks)
        at = begin[which]
        best = self.move[None] + e[at][:, None, :]
        for k in range(1, BLOCK):
            best = (best[:, :, :, None] + self.move[None, None]).max(axis=2) + e[at + k][:, None, :]
        return dict(zip(which.tolist(), best))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@lru_cache(maxsize=4)
def train(table: str = TABLE, steps: int = 150, rate: float = 0.3, decay: float = 0.02) -> Field:
    """Maximum likelihood with L2 decay, by forward and backward sums over the lines of the table."""
    lines = [_parse(x) for x in table.strip().splitlines()]
    raw = [t.encode() for t, _ in lines]
    w = analyse(raw)
    names = _tags()
    gold = np.zeros(len(w.shape), np.int64)
    begins = np.cumsum([len(r) + 1 for r in raw]) - [len(r) + 1 for r in raw]
    spans = [[(len(x[:a].encode()), len(x[:b].encode()), kind) for a, b, kind in found] for x, found in lines]  # in bytes
    seen: set[tuple[int, int]] = set()
    for k, i in enumerate(np.repeat(np.arange(len(raw)), w.counts)):
        for a, b, kind in spans[i]:
            if a <= w.starts[k] - begins[i] and w.ends[k] - begins[i] <= b:
                gold[k] = names.index(f"{'I' if (i, a) in seen else 'B'}-{kind}")
                seen.add((i, a))
    shapes = np.unique(w.shape)
    # words that occur once are trained as those that the table lacks
    known, times = np.unique(w.word, return_counts=True)
    known = known[times > 1]
    t = len(names)
    sizes = [*[len(shapes) + 2] * len(SHAPE_AT), *[len(known) + 2] * len(WORD_AT), 28, 4]
    field = Field(shapes, known, [np.zeros((s, t), np.float32) for s in sizes], np.zeros((t, t), np.float32), np.zeros(t, np.float32))
    for j, name in enumerate(names):  # a span's inside follows its begin
        if name[0] == "I":
            field.begin[j] = -1e4
            field.move[:, j] = -1e4
            field.move[[j - 1, j], j] = 0
    ids = field.ids(w)
    bounds = np.append(np.flatnonzero(np.diff(w.sentence, prepend=-1)), len(gold))
    params = [*field.emit, field.move, field.begin]
    sums = [np.full_like(p, 1e-6) for p in params]
    for _ in range(steps):
        grads = [-decay * p for p in params]
        grads[-2][field.move < -1e3] = 0
        grads[-1][field.begin < -1e3] = 0
        e = field.emissions(w).astype(np.float64)
        for a, b in zip(bounds, bounds[1:]):
            n = b - a
            alpha, beta = np.zeros((n, t)), np.zeros((n, t))
            alpha[0] = field.begin + e[a]
            for k in range(1, n):
                alpha[k] = _log_sum(alpha[k - 1][:, None] + field.move, 0) + e[a + k]
            for k in range(n - 2, -1, -1):
                beta[k] = _log_sum(field.move + (e[a + k + 1] + beta[k + 1])[None, :], 1)
            z = _log_sum(alpha[-1], 0)
            diff = -np.exp(alpha + beta - z)
            diff[np.arange(n), gold[a:b]] += 1
            for f, rows in enumerate(ids):
                np.add.at(grads[f], rows[a:b], diff)
            grads[-1] += diff[0]
            for k in range(1, n):
                pair = np.exp(alpha[k - 1][:, None] + field.move + (e[a + k] + beta[k])[None, :] - z)
                grads[-2] -= pair
                grads[-2][gold[a + k - 1], gold[a + k]] += 1
        for p, g, s in zip(params, grads, sums):
            s += g * g
            free = p > -1e3
            p[free] += (rate * g / np.sqrt(s))[free]
    return field


def _capital(raw: bytes, at: int) -> bool:
    """Whether the letter at a byte is a capital, or of a script without any."""
    letter = raw[at : at + 4].decode(errors="ignore")[:1]
    return letter.isalpha() and letter.upper() == letter


def added_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) that the field finds in each text, in code points."""
    raw = [t.encode() for t in texts]
    w = analyse(raw)
    tags = field.decode(w)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    hit = np.flatnonzero(tags)
    if not len(hit):
        return out
    names = _tags()
    begins = np.cumsum([len(r) + 1 for r in raw]) - [len(r) + 1 for r in raw]
    text_of = np.repeat(np.arange(len(texts)), w.counts)
    k = 0
    while k < len(hit):
        first = last = int(hit[k])
        kind = names[tags[first]][2:]
        while k + 1 < len(hit) and hit[k + 1] == last + 1 and names[tags[last + 1]] == f"I-{kind}" and text_of[last + 1] == text_of[first]:
            k += 1
            last += 1
        k += 1
        i = int(text_of[first])
        if kind == "name" and (first == last or not all(_capital(raw[i], p) for p in w.starts[first : last + 1] - begins[i])):
            continue  # two words at least, each with a capital
        a, b = int(w.starts[first] - begins[i]), int(w.ends[last] - begins[i])
        start = a if len(raw[i]) == len(texts[i]) else len(raw[i][:a].decode())
        out[i].append((start, start + (b - a if len(raw[i]) == len(texts[i]) else len(raw[i][a:b].decode())), kind))
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """For each text, the spans of the patterns, and those with what the field adds beside them."""
    out = []
    for text, more in zip(texts, added_spans(texts, field)):
        base = base_spans(text)
        new = [s for s in more if not any(s[0] < b and a < s[1] for a, b, _ in base)]
        out.append((base, sorted(base + new, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


NEW = {"n_email": "long", "n_ip": "long", "n_card": "long", "n_phone": "long", "base_spans": "string", "spans": "string", "redacted": "string"}


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Adds the counts of the patterns, base_spans and spans (`kind:start:end`, comma-joined) and redacted to docs.

    Whole texts are read, however long, and sentences of any length. Repeated rows and ties give equal rows; an empty table
    gives none.

    redacted is the text with every span replaced by `[KIND]`; of spans that overlap, the union is replaced once, under the
    kind of its first. Null texts are empty for the counts and spans, and stay null in redacted. Columns of the new names,
    in any case, are replaced; all others come back unchanged. Rows are independent of each other.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    shared = spark.sparkContext.broadcast(field or train())  # as large as the labelled table's words

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = texts_of(batch)
        found = all_spans(texts, shared.value)
        counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in BASE]
        clean = [None if null else redact(t, spans) for t, (_, spans), null in zip(texts, found, col(batch, "text").is_null().to_pylist())]
        return [*counts, pa.array([_joined(b) for b, _ in found], pa.string()), pa.array([_joined(s) for _, s in found], pa.string()), pa.array(clean, pa.string())]

    return beside(docs, NEW, work, 1 << 20)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:] if out else text


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
