"""Secret scans with inferred grammars (operator 3).

Base spans come from three fixed patterns.  The method adds spans of its own, of kind ``format``: of labelled
credentials a prefix tree is grown over character classes, statistically compatible states are merged
(Hoeffding bound) into a probabilistic automaton, and every long token of every text, whether a base pattern
touches it or not, is scored by how much likelier the automata make it than a model of ordinary long tokens
does.  Where the threshold lies is calibrated on strings held out of the fit: where the share of credentials that
pass, less ``FALSE_COST`` times the share of ordinary tokens that do, is largest.  Ordinary tokens bear no label, so
some may be credentials; that raises the cost of every threshold below them alike.

Labelled credentials are the values that the base patterns find (format ``assign``, ``access``, ``hex``)
in the whole corpus; ordinary tokens are its long tokens in which no base pattern finds anything and which are no
such value either.  Of each
format and of ordinary tokens a sample of its own is taken, by hash, so that the many don't crowd out the
few; pieces of more than ``PIECE_CHARS`` characters don't enter it.  The fit alone uses the samples; every
text is scanned whole.

Defined cases: a null text counts as empty; an empty text has no spans and the digest of the empty
string; with too few labelled credentials of a format it gets no automaton and the base spans stand
alone; with too few ordinary tokens all symbols count as equally likely in them.  Repeated rows and rows with
null ids give a row each, an empty table none.  Very long texts and tokens are scanned whole.  ``scan`` reads no
other column of docs, ``redact`` keeps all of them, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, materialize, set_aside

#: Bound of the fit: strings of one format, and of ordinary tokens.
SAMPLE_STRINGS = 2000
PIECE_CHARS = 512
MIN_STRINGS = 8
#: A token must be at least so many nats a character likelier as a credential than as an ordinary token.
MIN_GAIN = 0.3
#: How much more a share of ordinary tokens that pass weighs than one of credentials, when the threshold is set.
FALSE_COST = 5.0

# Kinds in their order, and the base patterns with their smallest lengths.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates of the grammars: long tokens that hold both a letter and a digit.
MIXED = re.compile(r"[A-Za-z].*[0-9]|[0-9].*[A-Za-z]")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: The base patterns as Spark tells pieces of texts apart by them.
PIECES = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
KEYWORDS = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, credential) of the three patterns, sorted by start, then kind."""
    out: list[tuple[int, int, int, str]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b, v) for a, k, b, v in sorted(out)]


def symbols(token: str) -> str:
    """Character classes: hexadecimal lower case h, other lower case l, upper case u, digit d, else the character."""
    return "".join("d" if c.isdigit() else "h" if "a" <= c <= "f" else "l" if "g" <= c <= "z" else "u" if "A" <= c <= "Z" else c for c in token)


@dataclass
class Automaton:
    """A probabilistic automaton as state -> {symbol: (next state, log probability)}; "" ends a string."""

    arcs: list[dict[str, tuple[int, float]]] = field(default_factory=list)

    def score(self, s: str) -> float:
        """Log probability a character; symbols without an arc cost as much as the rarest thing seen."""
        state, total = 0, 0.0
        for c in s:
            state, p = self.arcs[state].get(c, (state, -9.0)) if state < len(self.arcs) else (state, -9.0)
            total += p
        return (total + self.arcs[state].get("", (0, -9.0))[1]) / (len(s) + 1)


def infer(strings: Iterable[str], alpha: float = 0.05) -> Automaton:
    """Prefix tree of the strings, its compatible states merged in breadth-first order."""
    children: list[dict[str, int]] = [{}]
    through: list[dict[str, int]] = [defaultdict(int)]
    for s in strings:
        at = 0
        for c in s:
            through[at][c] += 1
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                through.append(defaultdict(int))
            at = children[at][c]
        through[at][""] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, b: int) -> bool:
        n, m = sum(through[a].values()), sum(through[b].values())
        if not n or not m:
            return False
        most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(through[a].get(c, 0) / n - through[b].get(c, 0) / m) > most for c in {*through[a], *through[b]})

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            if differ(x, y):
                return False
            stack += [(children[x][c], children[y][c]) for c in children[x] if c in children[y] and children[x][c] != children[y][c]]
            if len(stack) > 10_000:
                return False
        return True

    def fold(a: int, b: int) -> None:
        """Counts and branches of the tree below b join a."""
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            for c, k in through[y].items():
                through[x][c] += k
            for c, child in children[y].items():
                if c in children[x]:
                    stack.append((children[x][c], child))
                else:
                    children[x][c] = child

    kept = [0]
    edge = [(0, c) for c in sorted(children[0])]
    while edge:
        parent, c = edge.pop(0)
        new = children[parent][c]
        if new in kept:
            continue
        same = next((k for k in kept if compatible(k, new)), None)
        if same is None:
            kept.append(new)
            edge += [(new, x) for x in sorted(children[new])]
        else:
            children[parent][c] = same
            fold(same, new)
            edge += [(k, x) for k in kept for x in sorted(children[k]) if children[k][x] not in kept and (k, x) not in edge]
    index = {k: i for i, k in enumerate(kept)}
    out = Automaton()
    for k in kept:
        total = sum(through[k].values()) + 0.5
        out.arcs.append({c: (index[children[k][c]] if c else 0, math.log(n / total)) for c, n in through[k].items()})
    return out


@dataclass
class Grammars:
    formats: dict[str, Automaton]
    ordinary: Automaton | None
    #: The gain from which a token counts as a credential, and the shares of held-out credentials and ordinary tokens that reach it.
    threshold: float = MIN_GAIN
    found: float = 0.0
    false: float = 0.0

    def gain(self, token: str) -> float:
        """How many nats a character the best format is ahead of ordinary tokens."""
        return self.gain_of(symbols(token)) if self.formats else -math.inf

    def gain_of(self, s: str) -> float:
        ordinary = self.ordinary.score(s) if self.ordinary else -math.log(8)
        return max(a.score(s) for a in self.formats.values()) - ordinary

    def calibrate(self, credentials: list[str], ordinary: list[str]) -> None:
        """Sets the threshold from symbols of strings that the automata weren't made of."""
        if not self.formats:
            return
        true, false = [self.gain_of(s) for s in credentials], [self.gain_of(s) for s in ordinary]
        share = lambda gains, t: sum(g >= t for g in gains) / max(len(gains), 1)
        best = max({MIN_GAIN, *(g for g in true if g > MIN_GAIN)}, key=lambda t: (share(true, t) - FALSE_COST * share(false, t), t))
        below = max((g for g in [*true, *false, MIN_GAIN] if g < best), default=best)
        self.threshold = max(MIN_GAIN, (best + below) / 2)
        self.found, self.false = share(true, self.threshold), share(false, self.threshold)


def fit(docs: DataFrame, *, text_col: str = "text", sample_strings: int = SAMPLE_STRINGS) -> Grammars:
    """Automata of the base formats and of ordinary tokens, each from its own sample of at most ``sample_strings`` pieces of the whole corpus."""
    text = F.col(text_col)
    tokens = F.expr(f"regexp_extract_all(`{text_col}`, '[A-Za-z0-9+/_.=\\\\-]{{16,}}', 0)")
    around = F.expr(f"regexp_extract_all(`{text_col}`, '(?i)(?:password|passwd|secret|token|api_?key)[\"\\']?\\\\x20*[:=]\\\\x20*[\"\\']?[A-Za-z0-9+/_.=\\\\-]+', 0)")
    found = docs.where(text.isNotNull()).select(tokens.alias("tokens"), around.alias("around")).where(F.size("tokens") + F.size("around") > 0)
    values = F.transform("around", lambda a: F.regexp_extract(a, r"[A-Za-z0-9+/_.=-]+$", 0))
    # A value that another base pattern finds stays a piece of its own; the others only speak in their surroundings.
    own = F.array_intersect("tokens", F.filter(values, lambda v: v.rlike(f"{PIECES['access']}|{PIECES['hex']}")))
    found = found.select(F.concat(F.array_except("tokens", values), own, F.col("around")).alias("found"))
    pieces = found.select(F.explode("found").alias("piece")).where(F.length("piece") <= PIECE_CHARS).distinct()
    kinds = {kind: F.col("piece").rlike(pattern) for kind, pattern in PIECES.items()}
    long = F.col("piece").rlike(r"^[A-Za-z0-9+/_.=-]{16,}$")
    told = pieces.select("piece", F.xxhash64("piece").alias("h"), *[c.alias(k) for k, c in kinds.items()], (long & ~reduce(Column.__or__, kinds.values())).alias("ordinary"))
    told = materialize(told.where(reduce(Column.__or__, map(F.col, [*kinds, "ordinary"]))))
    sample = lambda kind: (r.piece for r in told.where(kind).orderBy("h", "piece").limit(sample_strings).select("piece").toLocalIterator())
    labelled = {kind: [symbols(v) for piece in sample(kind) for _, k, _, v in base_spans(piece) if k == kind][:sample_strings] for kind in kinds}
    ordinary = [symbols(piece) for piece in sample("ordinary")]
    # Every fourth string is held out of the automata and sets the threshold.
    rest = lambda v: [s for i, s in enumerate(v) if i % 4]
    enough = {k: v for k, v in labelled.items() if len(v) >= MIN_STRINGS}
    out = Grammars({k: infer(rest(v)) for k, v in enough.items()}, infer(rest(ordinary)) if len(ordinary) >= MIN_STRINGS else None)
    out.calibrate([s for v in enough.values() for s in v[::4]], ordinary[::4])
    return out


def spans_of(text: str | None, grammars: Grammars) -> list[tuple[int, str, int]]:
    """All spans (start, kind, end): the base ones, and those tokens that the grammars accept."""
    if not isinstance(text, str) or not text:
        return []
    base = [(a, k, b) for a, k, b, _ in base_spans(text)]
    extra = [(m.start(), "format", m.end()) for m in TOKEN.finditer(text) if MIXED.search(m[0]) and grammars.gain(m[0]) >= grammars.threshold]
    return sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[1])))


def scan(docs: DataFrame, grammars: Grammars, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``found``: every span of the whole text, offsets in code points, ends exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(grammars)

    def make(texts: list[str | None]) -> list:
        return [[[{"kind": k, "start": a, "end": b} for a, k, b in spans_of(t, shared.value)] for t in texts]]

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return add_columns(rows, "found array<struct<kind:string, start:bigint, end:bigint>>", lambda: make)


def redact(docs: DataFrame, grammars: Grammars, *, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, every span of the text replaced by ``mark``."""
    shared = docs.sparkSession.sparkContext.broadcast(grammars)

    def one(t: str | None) -> str | None:
        out, at = [], 0
        for a, _, b in spans_of(t, shared.value):
            if b > at:
                out += [t[at : max(a, at)], mark if a >= at else ""]
                at = b
        return "".join([*out, t[at:]]) if at else t

    aside, back = set_aside(docs, text_col)
    place = docs.columns.index(text_col)
    lean = aside.drop(f"_kept{place}")  # the text itself crosses once
    back[place] = F.col("_redacted").alias(text_col)
    return add_columns(lean, "_redacted string", lambda: lambda texts: [list(map(one, texts))]).select(*back)


def op3_secrets(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's spans."""
    found = scan(docs, fit(docs))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"] != "format")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.encode(written(base), "UTF-8"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), count("format").alias("n_format"),
    )
