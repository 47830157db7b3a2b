"""Main text of web pages through wrappers inferred per host.

Inference is union-free regular-expression alignment. A page becomes a stream of tags (with class and id) and
text slots. Adjacent equal runs of tokens fold into repeated groups. The stream is then aligned with the host's
wrapper so far: tokens on one side only become optional groups, and a text slot whose content differs between
pages becomes a variable slot, one that stays equal a constant of the template. Wrappers merge like pages do, so
every task folds its own pages first, and what moves is one small wrapper per host and task, merged in two
levels: a host with a third of all pages costs no more than its template.

Extraction reads the page's own tree. The wrapper says where the article is (an article or main element, else
the element whose slots vary and hold most text) and which slots are constants of the template: those on whose
content at least ``AGREEING`` pages agree that differ otherwise, in the article as outside. Menus, headers, footers,
sidebars, notices, adverts, forms and reader comments are also recognised by element, role, class and id.

Defined results: null html = empty html = empty text; a page without a host has wrapper "" with others of its
kind; a host with one page has no constants; cut-off pages and unclosed elements end at the page's end; repeated
rows are extracted each; extra columns are not read.
"""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, tidy, written

# Quotes count only at the start of a value; elsewhere they are plain characters. A tag ends before the next "<"
# outside quotes, and nothing is given back, so that tokens are found in linear time.
ATTRIBUTES = r"(?:=\s*+(?:\"[^\"]{0,65536}+\"|'[^']{0,65536}+'|[^\s><]++)?+|[^=><])*+"
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*+)"
    r"|<(script|style|template|svg|iframe|textarea|select|title)(?=[\s/>])" + ATTRIBUTES + r">(?:.*?</\1\s*+>|.*+)"
    r"|<(/?)([a-zA-Z][^\s/><]*+)(" + ATTRIBUTES + r")>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
NAMES = re.compile(r"(?<![^\s/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("math mfrac mi mn mo mover mroot mrow ms mspace msqrt msub msubsup msup mtext munder object canvas noscript a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav header footer aside form button dialog menu head".split())
#: Never boilerplate by their names; an article or main element also ends what names above it say.
CONTENT = frozenset("html body article main".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo breadcrumb breadcrumbs nav navbar navigation menu sidebar aside footer "
    "masthead cookie cookies consent notice notices alert popup modal newsletter subscribe signup share sharing social related comment comments respond "
    "disqus search pagination pager toolbar widget contentinfo complementary".split()
)
#: Words that say nothing by themselves beside those: a name is boilerplate when all its words are of either kind, so
#: that "site-footer" is and "comment-free" or "has-sidebar" isn't.
NEUTRAL = frozenset("area bar block bottom box button buttons container content form global group header inner item items left link links list main page panel policy posts primary right section secondary site slot top user wrap wrapper".split())
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Longest run of tokens that may repeat, and longest constant that is kept as it is (longer ones by their hash).
LONGEST_GROUP, LONGEST_CONSTANT = 24, 200
#: Pages of different content that must agree on a slot before it counts as the template's.
AGREEING = 3
#: Hosts that a task holds at once; beyond it, it emits their wrappers and starts anew.
HELD = 4000
#: The symbol of a text slot; tags and groups take the next private-use characters.
SLOT = "\ue000"


def _named_boilerplate(names: str) -> bool:
    """Whether one of the names (white space between them) is made of boilerplate words."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        if not BOILERPLATE_NAMES.isdisjoint(words) and all(w in BOILERPLATE_NAMES or w in NEUTRAL or w.isdigit() for w in words):
            return True
    return False


def walk(page: str):
    """Yields (path, text, boilerplate, breaks) for each text, and (token,) for each tag. path: open elements.

    breaks: whether a block boundary lies before the text."""
    stack: list[tuple[str, str, bool, bool]] = []  # (tag, token, boilerplate by element, by names)
    path, bad, at, broke = "", False, 0, True

    def opened():
        return ("/".join(x[1] for x in stack), stack[-1][2] or stack[-1][3]) if stack else ("", False)

    for m in TOKEN.finditer(page):
        if m.start() > at and page[at : m.start()].strip():
            yield path, page[at : m.start()], bad, broke
            broke = False
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            if tag not in INLINE:
                broke = True
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    path, bad = opened()
                    break
            yield ("/" + tag,)
            continue
        if tag == "p" or tag not in INLINE and tag != "br":
            broke = True
        if tag == "br":
            yield path, " ", bad, broke
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in CLOSED_BY.get(tag, ()):
                del stack[k:]
                break
            if stack[k][0] not in INLINE and stack[k][0] != "p":
                break
        names = " ".join((n[2] or n[3] or n[4] or "").lower() for n in NAMES.finditer(m[4])) if m[4] else ""
        token = ".".join([tag, *[w for w in re.split(r"[^a-z0-9]+", names) if w][:4]])
        yield (token,)
        if tag not in VOID and not m[4].endswith("/"):
            above = stack[-1][2:] if stack else (False, False)
            by_names = False if tag in ("article", "main") else above[1] or tag not in CONTENT and _named_boilerplate(names)
            stack.append((tag, token, above[0] or tag in BOILERPLATE, by_names))
        path, bad = opened()
    rest = re.split(r"<(?=[a-zA-Z!/?])", page[at:], maxsplit=1)[0]
    if rest.strip():
        yield path, rest, bad, broke


def _constant(text: str) -> str:
    """A slot's content, or its hash where it is long."""
    return text if len(text) <= LONGEST_CONSTANT else "#" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


class Wrapper:
    """A union-free regular expression over one-character tokens, with statistics of its text slots."""

    def __init__(self):
        self.alphabet: dict[str, str] = {"#": SLOT}
        self.groups: dict[str, str] = {}  # repeated run -> its symbol
        self.items: list[list] | None = None  # [symbol, optional]
        self.slots: dict[str, list] = {}  # path -> [constant or None, characters, fingerprints of up to AGREEING pages]
        self.known: set[str] = set()

    def symbol(self, token: str) -> str:
        return self.alphabet.get(token) or self.alphabet.setdefault(token, chr(0xE000 + len(self.alphabet)))

    def fold(self, stream: str) -> str:
        """Repeated groups replaced by their symbols, innermost first."""
        for _ in range(4):
            for run, symbol in self.groups.items():
                stream = re.sub(f"(?:{run}|{symbol})+", symbol, stream)
            m = re.search(r"(.{2,%d}?)\1+" % LONGEST_GROUP, stream, re.S)
            if not m:
                break
            while m:
                symbol = self.groups.setdefault(m[1], self.symbol("*" + m[1]))
                stream = re.sub(f"(?:{m[1]}|{symbol})+", symbol, stream)
                m = re.search(r"(.{2,%d}?)\1+" % LONGEST_GROUP, stream, re.S)
        return stream

    def align(self, items: list[list]) -> None:
        """Merge another sequence of items; what only one side has becomes optional."""
        if self.items is None:
            self.items = items
            return
        mine, theirs = [x[0] for x in self.items], [x[0] for x in items]
        out = []
        for kind, a, b, c, d in difflib.SequenceMatcher(None, mine, theirs, autojunk=False).get_opcodes():
            if kind == "equal":
                out += [[s, x[1] or y[1]] for s, x, y in zip(mine[a:b], self.items[a:b], items[c:d])]
            else:
                out += [[s, True] for s in mine[a:b]] + [[s, True] for s in theirs[c:d] if [s, True] not in self.items[max(0, a - 1) : b + 1]]
        self.items = out
        self.known.clear()

    def learn(self, page: str) -> None:
        tokens, seen = [], {}
        for x in walk(page):
            if len(x) == 1:
                tokens.append(self.symbol(x[0]))
            elif x[1] != " ":
                if not tokens or tokens[-1] != SLOT:
                    tokens.append(SLOT)
                seen.setdefault(x[0], []).append(x[1])
        stream = self.fold("".join(tokens))
        if stream not in self.known:
            if self.items is None or not re.fullmatch("".join(s + "?" * o for s, o in self.items), stream):
                if self.items is not None:  # new groups may occur in what was learnt before
                    flags = {s: o for s, o in self.items}
                    self.items = [[s, flags.get(s, False)] for s in self.fold("".join(s for s, _ in self.items))]
                self.align([[s, False] for s in stream])
            if len(self.known) < 64:
                self.known.add(stream)
        own = zlib.crc32("".join(x for texts in seen.values() for x in texts).encode("utf-8", "surrogatepass"))
        for path, texts in seen.items():
            whole = "".join(texts)
            self._slot(path, _constant(whole), len(whole), [own])

    def _slot(self, path: str, constant: str | None, chars: int, pages: list[int]) -> None:
        mine = self.slots.get(path)
        if mine is None:
            self.slots[path] = [constant, chars, pages]
        else:
            mine[0] = mine[0] if mine[0] == constant else None
            mine[1] += chars
            if len(mine[2]) < AGREEING:
                mine[2] = sorted({*mine[2], *pages})[:AGREEING]

    def merge(self, other: Wrapper) -> None:
        back = {c: t for t, c in other.alphabet.items()}

        def mapped(c: str) -> str:
            token = back[c]
            if token.startswith("*"):
                run = "".join(map(mapped, token[1:]))
                return self.groups.setdefault(run, self.symbol("*" + run))
            return self.symbol(token)

        if other.items is not None:
            self.align([[mapped(s), o] for s, o in other.items])
        for path, (constant, chars, pages) in other.slots.items():
            self._slot(path, constant, chars, pages)

    def dump(self) -> str:
        return json.dumps([self.alphabet, self.groups, self.items, self.slots])

    @classmethod
    def load(cls, text: str) -> Wrapper:
        out = cls()
        out.alphabet, out.groups, out.items, out.slots = json.loads(text)
        return out

    def expression(self) -> str:
        """The wrapper in readable form."""
        back = {c: t for t, c in self.alphabet.items()}
        shown = lambda c: f"({' '.join(map(shown, back[c][1:]))})+" if back[c].startswith("*") else back[c]
        return " ".join(shown(s) + "?" * o for s, o in self.items or [])

    def rules(self) -> str:
        """What extraction needs: the article's path ("" to judge by the page alone) and constant slots."""
        weight: dict[str, int] = {}
        named = None
        for path, (constant, chars, _) in self.slots.items():
            parts = path.split("/")
            for k, part in enumerate(parts):
                if named is None and part.split(".")[0] in ("article", "main"):
                    named = "/".join(parts[: k + 1])
                if constant is None:
                    prefix = "/".join(parts[: k + 1])
                    weight[prefix] = weight.get(prefix, 0) + chars
        root = named
        if root is None and weight:
            most = max(weight.values())
            root = max((p for p in weight if weight[p] >= 0.8 * most), key=lambda p: (p.count("/"), p))
            if root.split("/")[-1].split(".")[0] in ("p", "li", "td", *INLINE):
                root = root.rpartition("/")[0]
        # Slots that pages of different content agree on are the template's, inside the article too.
        fixed = {p: s[0] for p, s in self.slots.items() if s[0] is not None and len(s[2]) >= AGREEING}
        inside = lambda p: root is None or p == root or p.startswith(root + "/")
        if not any(s[0] is None and inside(p) for p, s in self.slots.items()):
            fixed = {}
        return json.dumps([root or "", fixed])


def main_text(page: str, rules: str | None = None) -> str:
    root, fixed = json.loads(rules) if rules else ("", {})
    items = [x for x in walk(page) if len(x) == 4]
    whole: dict[str, list[str]] = {}
    for path, text, _, _ in items:
        if path in fixed and text != " ":
            whole.setdefault(path, []).append(text)
    template = {path for path, texts in whole.items() if _constant("".join(texts)) == fixed[path]}

    def blocks(root: str) -> list[str]:
        out, own = [], []
        for path, text, bad, broke in items:
            if broke and own:
                out.append("".join(own))
                own = []
            if bad or path in template or root and path != root and not path.startswith(root + "/"):
                continue
            own.append(text)
        out.append("".join(own))
        return [b for b in (" ".join(html.unescape(x).split()) for x in out) if b]

    found = blocks(root)
    if not found and root:  # a page unlike its host's others
        found = blocks("")
    return "\n\n".join(found)


def wrappers(pages: DataFrame, host: str = "host", page: str = "html", fan_in: int = 32) -> DataFrame:
    """(host, wrapper) from (host, html) rows: partial wrappers per task, merged in two levels."""

    def learn(batches):
        held: dict[str, Wrapper] = {}
        task = TaskContext.get().partitionId()

        def emit():
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([task] * len(held), pa.int32()), pa.array([w.dump() for w in held.values()])], ["host", "task", "wrapper"])
            held.clear()

        for b in batches:
            for h, x in zip(b.column(0), b.column(1)):
                key = h.as_py()
                if key not in held and len(held) >= HELD:
                    yield from emit()
                held.setdefault(key, Wrapper()).learn(x.as_py() or "")
        yield from emit()

    def merge(batches):  # rows come sorted by host, so that one wrapper is held at a time
        last, own = None, None
        for b in batches:
            out = []
            for h, w in zip(b.column("host").to_pylist(), b.column("wrapper").to_pylist()):
                if own is not None and h == last:
                    own.merge(Wrapper.load(w))
                    continue
                if own is not None:
                    out.append((last, own.dump()))
                last, own = h, Wrapper.load(w)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["host", "wrapper"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([own.dump()])], ["host", "wrapper"])

    parts = pages.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(page).cast("string").alias("html")).mapInArrow(tidy(learn), "host string, task int, wrapper string")
    parts = parts.withColumn("part", F.floor(F.col("task") / fan_in))
    once = parts.repartition("host", "part").sortWithinPartitions("host", "part", "task")
    # Within a partition one host may have several parts; merging them together is merging early.
    once = once.select("host", "wrapper").mapInArrow(tidy(merge), "host string, wrapper string")
    return once.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(tidy(merge), "host string, wrapper string")


def extract(pages: DataFrame, url: str = "url", page: str = "html", to: str = "main_text") -> DataFrame:
    """``pages`` with a string column ``to``, in place of one of that name."""
    kept = [f for f in pages.schema.fields]
    packed = pages.select(F.struct("*").alias("row"), F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://([^/?#]+)", 1), F.lit("")).alias("host"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"))

    def rule(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([Wrapper.load(w).rules() for w in b.column("wrapper").to_pylist()], pa.string())], ["rule_host", "rules"])

    rules = written(wrappers(packed.select("host", "html")).mapInArrow(rule, "rule_host string, rules string"), "wrapper-rules")
    joined = packed.join(maybe_broadcast(rules, 100_000), F.col("host") == F.col("rule_host"), "left")

    @F.pandas_udf("string")
    def text_of(html_column, rules_column):
        return html_column.combine(rules_column, main_text)

    return joined.select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in kept if f.name != to], text_of("html", "rules").alias(to))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))
