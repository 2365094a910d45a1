"""Personal data: fixed patterns, and a linear-chain CRF for forms that they do not reach.

The CRF labels words from their shapes and their neighbours' shapes.  It is trained on a small
labelled table, some lines as they stand and the rest made by rule in the corpus's languages, by
gradient ascent on the log-likelihood.  Whole texts are scored with numpy, a distinct word at a time,
and decoded by Viterbi for many texts side by side; only texts without a digit or "@" are left out, as
no span of theirs could hold.  What the chain adds must still hold as its kind (Luhn, digit counts, parts).
"""

from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
# fixed values: the base patterns
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NO_DIGIT = re.compile(r"[^0-9]")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TELLING = re.compile(r"[0-9@]")
#: Distinct words whose features a task remembers.
REMEMBERED = 200_000
#: Cells (sequences times words) of one Viterbi block.
BLOCK = 200_000

COLUMNS = T.StructType(
    [T.StructField(f"n_{k}", T.LongType(), False) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType(), False), T.StructField("spans", T.StringType(), False), T.StructField("n_crf", T.LongType(), False)]
)

#: The labelled table: text in which [kind:...] marks personal data.
LABELLED = (
    "call me at [phone:(555) 010-2233] before noon",
    "phone [phone:555-010-2233] or write",
    "my number is [phone:555.010.2233] since may",
    "tel [phone:(020) 7946-0958] office hours",
    "Tel: [phone:030 901820 44] Berlin",
    "fax [phone:(040) 555-0147] and mail",
    "[phone:(212) 555-0199] is the desk",
    "reach us on [phone:(415) 555-0132] or [phone:(415) 555-0133] today",
    "mobile [phone:0171-5550123] weekdays",
    "dial [phone:1-800-555-0100] now",
    "cell: [phone:555-010-9988].",
    "ring [phone:(818) 555-0142], ask for Ann",
    "pay with card [card:4111.1111.1111.1111] please",
    "card number [card:4111/1111/1111/1111] expires 12/27",
    "visa [card:5500.0000.0000.0004] on file",
    "charged to [card:4012_8888_8888_1881] in june",
    "her card [card:3782.822463.10005] was lost",
    "card: [card:6011.1111.1111.1117], code 123",
    "mail [email:anna@localhost] about it",
    "send to [email:root@server1] only",
    "write to [email:bob(at)@mail] instead",
    "admin is [email:ops@intranet] here",
    "contact [email:müller@post.example.de] soon",
    "from [email:josé.pérez@correo.example.es] today",
    "host [ip:10.0.0.1:8080] is down",
    "ping [ip:192.168.1.20/24] twice",
    "server at [ip:172.16.0.9:443] answered",
    "the address [ip:8-8-8-8] resolves",
    "peer [ip:10_20_30_40] joined",
    "version 2.0.1 was released in 2019",
    "licensed under version 3 of 2007",
    "released 4.0. in may",
    "on 2021-03-14 at 10:30 we met",
    "from 01/02/2003 to 04.05.2006 only",
    "room 1204 on floor 12",
    "page 33 of 455 in volume 2",
    "costs 1,299.00 or 1.299,00 each",
    "order 1234567890 was shipped",
    "id 20210314 belongs to 99887766",
    "about 5000000000 people and 3.14159 more",
    "in 1984 and 1985 there were 365 days",
    "sum 100 200 300 400 in the row",
    "hash 24be64439e3e49cf46b2d7c90f3602a3d0b907ff ok",
    "commit 9f1c2ab and e45c2b1 merged",
    "isbn 978-3-16-148410-0 is a book",
    "scored 3-2 and 10-8 last week",
    "see section 4.3.2.1 of chapter 7",
    "model X200 and B-52 and 747-400 flew",
    "@anna wrote to @bob and @carl",
    "price @ 5 each for 10",
    "coordinates 52.5200 13.4050 were sent",
    "part no. 555-0102-77 in stock",
    "temperature 21.5 to 23.75 degrees",
    "lines 100-200 and 300-455 changed",
)
#: Lines of the made part: {kind} is filled with personal data of a form that the base patterns miss,
#: {plain} with other figures.
LINES = (
    "please call {phone} before noon", "our number is {phone} or {phone} at night", "phone: {phone}", "tel. {phone}, fax {phone}", "you can reach her under {phone} most days",
    "the card {card} was declined", "we charged card {card} twice", "card no. {card} expires soon", "paid by {card} and {card}", "write to {email} for help",
    "mail {email} or {email}", "the sender was {email} again", "host {ip} refused", "the server {ip} and {ip} are down", "connect to {ip} please",
    "bitte rufen Sie {phone} an", "Telefon {phone} oder {phone}", "Tel: {phone} im Büro", "die Karte {card} ist gesperrt", "Kartennummer {card} bitte", "schreiben Sie an {email} heute",
    "der Rechner {ip} antwortet nicht", "appelez le {phone} ce soir", "téléphone {phone} ou {phone}", "la carte {card} est perdue", "numéro de carte {card} merci",
    "écrivez à {email} demain", "le serveur {ip} est lent", "llame al {phone} mañana", "mi teléfono es {phone} siempre", "la tarjeta {card} no vale", "pague con {card} hoy",
    "escriba a {email} ahora", "el servidor {ip} no responde", "released {plain} and {plain} last year", "order {plain} was shipped on {plain}", "see page {plain} of {plain}",
    "about {plain} people came", "the file {plain} has {plain} lines", "version {plain} costs {plain}", "am {plain} gab es {plain} davon", "Seite {plain} von {plain}", "le {plain} il y avait {plain}",
    "{ip} replied to {ip}", "trace {ip} now", "blocked {ip} and {ip}", "von {ip} nach {ip}", "depuis {ip} vers {ip}", "desde {ip} hasta {ip}",
    "el {plain} hubo {plain} casos", "id {plain} and key {plain}", "score {plain} to {plain} in {plain}", "token = {plain} was used", "license version {plain} of {plain}",
)
#: Forms, # being a digit, @ a letter, ~ a number up to 255 and = a card's digits with a right check digit.
FORMS = {
    "phone": (
        "(###) ###-####", "###-###-####", "###.###.####", "(0##) ####-####", "0### ######", "0###/#######", "0###-#######", "0## ####### ##", "1-8##-###-####", "01 ## ## ## ##", "06.##.##.##.##",
        "9## ### ###", "6##-###-###", "(0####) ######", "00## ## #######",
    ),
    "card": ("====.====.====.====", "====/====/====/====", "====_====_====_====", "==== ==== ==== ==== ,", "======.========.==", "====:====:====:====", "================ ================"),
    "email": ("@@@@@@localhost", "@@@@_@@@(at)@@@@@host", "@@@.@@@@@mail", "@@@@@@@@server#", "é@@@@@@@@@.example", "@@ü@@@@@@@@.example.de", "@@@@##@@intra"),
    "ip": ("~.~.~.~:####", "~.~.~.~/##", "~-~-~-~", "~_~_~_~", "~.~.~.~:##", "~.~.~.~/~", "~,~,~,~"),
    "plain": ("20##", "19##", "##", "###", "#.#", "#.#.#", "20##-0#-1#", "1#/0#/20##", "1#:##", "#,###.##", "#.###,##", "##%", "########", "#############", "@#@##@@#@##@", "##-###", "#-#", "###x###", "N###", "####-####"),
}
MARK = re.compile(r"\[(\w+):([^\]]*)\]")


def filled(form: str, rng: random.Random) -> str:
    out = [rng.choice("0123456789") if c == "#" else str(rng.randint(1, 254)) if c == "~" else c for c in form]
    # of two letter marks side by side in an address one is the sign itself
    cut = [i for i, c in enumerate(out) if c == "@"]
    sign = cut[len(cut) * 2 // 3] if cut and "mail" in form or "host" in form or "server" in form or "example" in form or "intra" in form else -1
    out = [rng.choice("abcdefghiklmnoprstuvw") if c == "@" and i != sign else c for i, c in enumerate(out)]
    cards = [i for i, c in enumerate(out) if c == "="]
    for i in cards:
        out[i] = rng.choice("0123456789")
    if cards:
        digits = "".join(out[i] for i in cards[:-1])
        out[cards[-1]] = next(d for d in "0123456789" if luhn(digits + d))
    return "".join(out).removesuffix(" ,")


def made_lines(lines: tuple[str, ...] = LINES, rounds: int = 12, seed: int = 1) -> list[str]:
    """Every line ``rounds`` times with other fillings, marked like ``LABELLED``."""
    rng = random.Random(seed)

    def fill(m: re.Match) -> str:
        value = filled(rng.choice(FORMS[m[1]]), rng)
        return value if m[1] == "plain" else f"[{m[1]}:{value}]"

    return [re.sub(r"\{(\w+)\}", fill, line) for line in lines for _ in range(rounds)]


def shape(word: str) -> str:
    """Runs of digits with their length, of letters without, other characters as they are."""
    word = re.sub(r"[0-9]+", lambda m: f"\x00{min(len(m[0]), 9)}", word)
    word = re.sub(r"[^\W\d_]+", "x", word)
    return word.replace("\x00", "d")


def features(words: list[str]) -> list[list[str]]:
    shapes = [shape(w) for w in words]
    padded = ["^", *shapes, "$"]
    rows = []
    for i, word in enumerate(words):
        core = shapes[i].strip(".,;:!?")
        digits = sum(c.isdigit() for c in word)
        row = [f"s={core}", f"p={padded[i]}", f"n={padded[i + 2]}", f"d={min(digits, 20)}", f"u={re.sub('[0-9]', '', core)}", f"ps={padded[i]}|{core}", f"sn={core}|{padded[i + 2]}"]
        before = words[i - 1].lower().strip(".,:;") if i else "^"
        row.append(f"b={before}")
        if "@" in word:
            row.append("at")
        rows.append(row)
    return rows


def labelled_rows(table: tuple[str, ...] | list[str] = LABELLED) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of every text of the labelled table."""
    rows = []
    for text in table:
        words, labels, at = [], [], 0
        for m in MARK.finditer(text):
            plain = text[at : m.start()].split()
            marked = m[2].split()
            words += plain + marked
            labels += ["O"] * len(plain) + [m[1]] * len(marked)
            at = m.end()
        rest = text[at:].split()
        if rest and at and not text[at].isspace():  # punctuation right after a mark belongs to its word
            words[-1] += rest.pop(0)
        rows.append((words + rest, labels + ["O"] * len(rest)))
    return rows


class Chain:
    """Weights of a linear-chain CRF: one row per feature, a transition matrix, start scores."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> None:
        self.names, self.emit, self.move, self.start = names, emit, move, start
        self.none = len(names)
        self.padded = np.vstack([emit, np.zeros(len(LABELS))])
        # shapes and cores that pairs of the table hold, and the pairs' rows
        pairs = {kind: [(f[len(kind) + 1 :].split("|", 1), row) for f, row in names.items() if f.startswith(kind + "=")] for kind in ("ps", "sn")}
        self.outer = {v: n for n, v in enumerate(sorted({p[0] for p, _ in pairs["ps"]} | {p[-1] for p, _ in pairs["sn"]}), 1)}
        self.cores = {v: n for n, v in enumerate(sorted({p[-1] for p, _ in pairs["ps"]} | {p[0] for p, _ in pairs["sn"]}), 1)}
        self.before, self.after = (np.full((len(self.outer) + 1, len(self.cores) + 1), self.none) for _ in range(2))
        for (outer, core), row in pairs["ps"]:
            self.before[self.outer[outer], self.cores[core]] = row
        for (core, outer), row in pairs["sn"]:
            self.after[self.outer[outer], self.cores[core]] = row
        self.seen: dict[str, int] = {}
        self.known: list[tuple[int, ...]] = []

    def scores(self, words: list[str]) -> np.ndarray:
        rows = [[self.names[f] for f in row if f in self.names] for row in features(words)]
        return np.array([self.emit[r].sum(axis=0) if r else np.zeros(len(LABELS)) for r in rows])

    def _word(self, word: str) -> tuple[int, ...]:
        """What a word is as itself (s, d, u, at), as a neighbour (p, n, b), and in pairs."""
        whole = shape(word) if word not in ("\x02^", "\x02$") else word[1]
        core = whole.strip(".,;:!?")
        digits = min(sum(c.isdigit() for c in word), 20)
        before = "^" if word == "\x02^" else word.lower().strip(".,:;")
        row = lambda f: self.names.get(f, self.none)
        return (
            row(f"s={core}"), row(f"d={digits}"), row(f"u={re.sub('[0-9]', '', core)}"), row("at") if "@" in word else self.none,
            row(f"p={whole}"), row(f"n={whole}"), row(f"b={before}"), self.outer.get(whole, 0), self.cores.get(core, 0),
        )

    def all_scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        """What ``scores`` gives for each list of words, found from the distinct words at once."""
        if len(self.seen) > REMEMBERED:
            self.seen, self.known = {}, []
        seen, known = self.seen, self.known
        stream = ["\x02^"]
        for words in texts:
            stream += words
            stream += ("\x02$", "\x02^")
        for word in set(stream):
            if word not in seen:
                seen[word] = len(known)
                known.append(self._word(word))
        table = np.array(known)
        at = np.fromiter(map(seen.__getitem__, stream), np.int64, len(stream))
        mine, left, right = table[at[1:-1]], table[at[:-2]], table[at[2:]]
        rows = [mine[:, 0], mine[:, 1], mine[:, 2], mine[:, 3], left[:, 4], right[:, 5], left[:, 6], self.before[left[:, 7], mine[:, 8]], self.after[right[:, 7], mine[:, 8]]]
        total = np.zeros((len(mine), len(LABELS)))
        for row in rows:
            total += self.padded[row]
        out, start = [], 0
        for words in texts:
            out.append(total[start : start + len(words)])
            start += len(words) + 2
        return out


def training_lines() -> list[str]:
    return [*LABELLED, *made_lines()]


def train(table: tuple[str, ...] | list[str] | None = None, rounds: int = 150, rate: float = 0.1, decay: float = 0.01) -> Chain:
    """Fit a chain to the labelled table (Adam on the penalised log-likelihood, all rows at once)."""
    rows = labelled_rows(training_lines() if table is None else table)
    names: dict[str, int] = {}
    coded = [[[names.setdefault(f, len(names)) for f in row] for row in features(words)] for words, _ in rows]
    n_labels, width = len(LABELS), max((len(w) for w, _ in rows), default=1)
    mask = np.zeros((len(rows), width), bool)
    gold = np.zeros((len(rows), width), int)
    # every word's features, filled up with one that counts for nothing
    most, none = max((len(ids) for row in coded for ids in row), default=1), len(names)
    held = np.full((len(rows), width, most), none)
    for r, (words, labels) in enumerate(rows):
        mask[r, : len(words)] = True
        gold[r, : len(words)] = [LABELS.index(x) for x in labels]
        for t, ids in enumerate(coded[r]):
            held[r, t, : len(ids)] = ids
    flat = held.ravel()
    weights = [np.zeros((len(names), n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    hot = np.eye(n_labels)[gold] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_moves = np.einsum("rta,rtb,rt->ab", hot[:, :-1], hot[:, 1:], both)
    for step in range(1, rounds + 1):
        emit, move, start = weights
        scores = np.vstack([emit, np.zeros(n_labels)])[held].sum(axis=2)
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0] + start
        for t in range(1, width):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + move, axis=1) + scores[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            new = np.logaddexp.reduce(move + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        marginal = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        joint = forward[:, :-1, :, None] + move + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        moves = np.einsum("rtab,rt->ab", np.exp(np.minimum(joint, 0)), both)
        apart = np.repeat((hot - marginal)[:, :, None, :], most, axis=2).reshape(-1, n_labels)
        slopes = [
            np.stack([np.bincount(flat, apart[:, k], none + 1)[:none] for k in range(n_labels)], axis=1) - decay * emit,
            gold_moves - moves - decay * move,
            hot[:, 0].sum(axis=0) - marginal[:, 0].sum(axis=0) - decay * start,
        ]
        for i, slope in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope**2
            weights[i] = weights[i] + rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Chain(names, *weights)


def viterbi(chain: Chain, sequences: list[np.ndarray]) -> list[np.ndarray]:
    """The best labels of every score sequence, sequences of like length side by side."""
    out: list[np.ndarray] = [np.empty(0, int)] * len(sequences)
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    at = 0
    while at < len(order):
        width, end = 0, at
        while end < len(order) and (end == at or (end - at + 1) * len(sequences[order[end]]) <= BLOCK):
            width = len(sequences[order[end]])
            end += 1
        block = order[at:end]
        length = np.array([len(sequences[i]) for i in block])
        scores = np.zeros((len(block), width, len(LABELS)))
        for r, i in enumerate(block):
            scores[r, : length[r]] = sequences[i]
        best = scores[:, 0] + chain.start
        came = np.zeros((len(block), width, len(LABELS)), np.int8)
        for t in range(1, width):
            options = best[:, :, None] + chain.move
            came[:, t] = options.argmax(axis=1)
            new = options.max(axis=1) + scores[:, t]
            best = np.where((t < length)[:, None], new, best)
        labels = np.zeros((len(block), width), int)
        current = best.argmax(axis=1)
        for t in range(width - 1, -1, -1):
            labels[:, t] = current
            previous = came[np.arange(len(block)), t, current]
            current = np.where((t < length) & (t > 0), previous, current)
        for r, i in enumerate(block):
            out[i] = labels[r, : length[r]]
        at = end
    return out


def luhn(digits: str) -> bool:
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of [A-Za-z0-9._%+-]+@domain, found from every "@" outwards in linear time."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns by kind, then start."""
    found = [(a, b, "email") for a, b in emails(text)]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if holds("ip", m[0])]
    found += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if holds("card", m[0])]
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if holds("phone", m[0])]
    return found


def holds(kind: str, value: str) -> bool:
    digits = NO_DIGIT.sub("", value)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def plausible(kind: str, value: str) -> bool:
    """Whether a span that the chain found still holds as its kind."""
    if kind == "email":
        return "@" in value[1:-1]
    if kind == "ip":
        parts = [p for p in re.split(r"[^0-9]+", value) if p]
        return len(parts) >= 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts[:4])
    return holds(kind, value)


def found_spans(text: str, bounds: list[tuple[int, int]], labels: np.ndarray, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The labelled runs of words that hold as their kind and touch no base span.

    Neighbours of one kind are one span if they hold together, or else each that holds alone.
    """
    def kept(kind: str, a: int, b: int) -> tuple[int, int, str] | None:
        value = text[a:b]
        b -= len(value) - len(value.rstrip(".,;:!?)\"'>*#$%&|"))
        value = text[a:b]
        a += len(value) - len(value.lstrip(".,;:!?\"'<*#$%&|"))
        if a < b and plausible(kind, text[a:b]) and not any(a < y and x < b for x, y, _ in base):
            return a, b, "crf"
        return None

    out = []
    named = np.flatnonzero(labels)
    if not len(named):
        return out
    for part in np.split(named, np.flatnonzero((np.diff(named) > 1) | (labels[named[1:]] != labels[named[:-1]])) + 1):
        kind = LABELS[labels[part[0]]]
        if whole := kept(kind, bounds[part[0]][0], bounds[part[-1]][1]):
            out.append(whole)
        else:
            out += [one for k in part if (one := kept(kind, *bounds[k]))]
    return out


def scan(chain: Chain, texts: list[str]) -> dict:
    made: dict[str, list] = {f.name: [] for f in COLUMNS}
    bases = [base_spans(text) if TELLING.search(text) else [] for text in texts]
    telling = [i for i, text in enumerate(texts) if TELLING.search(text)]
    words = [[(m[0], m.span()) for m in WORD.finditer(texts[i])] for i in telling]
    labelled = viterbi(chain, chain.all_scores([[w for w, _ in row] for row in words]))
    added = {i: found_spans(texts[i], [b for _, b in row], labels, bases[i]) for i, row, labels in zip(telling, words, labelled)}
    for i, base in enumerate(bases):
        counts = Counter(k for _, _, k in base)
        for kind in KINDS:
            made[f"n_{kind}"].append(counts[kind])
        made["base_sha256"].append(sha256(joined(base).encode()).hexdigest())
        made["spans"].append(joined([*base, *added.get(i, [])]))
        made["n_crf"].append(len(added.get(i, [])))
    return made


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", table: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """Counts, digest and spans (code points, end exclusive) per row of ``docs``.

    Base spans always stay; ``crf`` spans are those that only the chain finds.  A null text is
    empty and has none; repeated rows and null ids give a row each; an empty table gives no rows.
    Other columns are not read, whatever their names.  Texts are decoded whole, in time and memory
    in proportion to their length.  ``table`` holds the labelled lines, by default ``training_lines()``.
    """
    chain = train(table)

    def make():
        return lambda texts: scan(chain, texts)

    return map_texts(docs, [doc_id], text, COLUMNS, make)
