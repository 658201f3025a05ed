"""HTML extraction by two-pass block rules.

First pass: every block of text (a maximal run of text between block-level tags) is decided by its own figures - share
of stop words, length, share of characters inside links, and the role of the elements around it - as text, boilerplate,
or, when it is short or long with a middling share of stop words, undecided. Second pass: an undecided block takes the label of
its nearest decided neighbour; inside an article element only neighbours of that article count, and between two equally near
ones text wins there, boilerplate elsewhere. Without any decided neighbour a block is text inside an article and boilerplate
outside.

Roles come in three strengths. Elements for navigation, forms and the like, their ARIA roles and hidden elements are
boilerplate. So are class and id words for comments, adverts, notices and the like, on articles too; but a word that tells how
a page is laid out (has-sidebar, content-sidebar-wrap) is no role, and where such words leave a page without any text, the one
whose element has most prose is passed over (comments apart). Words that content carries as well (share, header, banner) are overruled by words for content beside them
(share-story-body) and by long prose without links.

Stop words are known for eight languages. Where a page has next to none of them, its language is another one, and length, links
and sentence ends decide instead.

Null or empty html: no text. Broken markup, unclosed elements and cut-off pages are read as far as they go; very long pages are
read whole, in time that grows with their length. Rows are handled one by one, so ties, repeated rows, empty tables and
further columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# --- fixed values: element names, role words and the commonest words of eight languages
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes noscript template xmp svg math canvas object audio video".split())
BAD_TAGS = set("nav footer aside form button select dialog menu head legend fieldset optgroup option search label".split())
BAD_ROLES = set("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
BAD_WORDS = set("ad ads adv advert advertisement advertising adbox adslot sponsor sponsored promo promotion teaser sidebar cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login related recommended recommendations comment comments discussion replies reply respond disqus breadcrumb breadcrumbs pagination pager menu nav navbar navigation footer copyright disclaimer".split())
WEAK_WORDS = set("alert banner header masthead share sharing sharebar social toolbar topbar widget".split())
CONTENT_WORDS = set("article body content entry main post prose story text".split())
COMMENT_WORDS = set("comment comments discussion replies reply respond disqus".split())
LAYOUT_WORDS = set("container grid layout page row site wrap wrapper".split())
STATE_WORDS = set("has hide is js no not show with without".split())
STOP = set(
    "a an and are as at be been but by can for from had has have he her his i if in into is it its of on or our she so than that the their them then there these they this to was we were which who will with would you your "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so um und uns vom von vor war wie wir wird zu zum zur über "
    "al alla anche che chi come con da dal dalla degli dei del della delle di dove e è era essere gli ha hanno i il in io la le lo ma mi nel nella non o per perché più quando quello questa questo se si sono sua suo sul sulla tra un una "
    "a ao aos as com como da das de do dos e ela ele em entre era essa esse esta foi há isso mais mas me na não nas no nos o os ou para pela pelo por que quem se sem ser seu sua são também um uma "
    "aan als bij dat de die dit door een en er had heb heeft het hij hoe hun ik in is je kan maar me met mijn naar niet nog of om ook op over te tot uit van voor was wat we wel werd wij worden zich zijn zo zou "
    "att av de den det där då efter eller en ett från för ha hade han har hon i in inte jag kan man med men mot när och om på sig sin som så till under upp ut var vi vid är "
    "al como con de del el ella en entre era es esta este fue ha hay la las lo los más me mi muy no o para pero por porque que se ser si sin sobre son su sus también un una y ya".split()
)
SHORT, LONG, STOP_NONE, STOP_FEW, STOP_SOME, STOP_MANY, LINKS_MOST = 60, 200, 0.05, 0.09, 0.18, 0.30, 0.40

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_SENTENCE = re.compile(r"[.!?…。！？।؟][\"'”’»)]*$")
_TRIM = re.compile(r"^\W+|\W+$|\d+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    bad: int  # the strongest role around it: 0 none, 1 weak word, 2 word, 3 element or comments
    owner: int  # number of the outermost element whose word gave role 2, 0: none
    article: int  # number of the article or main element around it, 0: none
    heading: bool
    label: str = ""
    parts: list = field(default_factory=list)


def _word_role(token: str, article: bool) -> int:
    """The role that one class or id gives: 0 none, 1 weak, 2 strong, 3 comments. On articles the first of its words has to say so."""
    words = [w for w in _SPLIT.split(token) if w]
    if not words or words[0] in LAYOUT_WORDS or STATE_WORDS.intersection(words):
        return 0
    said = set(words[:1] if article else words)
    if said & COMMENT_WORDS:
        return 3
    if words[0] in BAD_WORDS or said & BAD_WORDS and not said & LAYOUT_WORDS:
        return 2
    return int(not article and not said & CONTENT_WORDS and bool(said & WEAK_WORDS))


def _role(tag: str, attrs: str, in_article: bool) -> int:
    if tag in BAD_TAGS or tag == "header" and not in_article:
        return 3
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return 0
    found = 0
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 3
        if name == "role" and value in BAD_ROLES:
            return 3
        if name in ("class", "id") and tag not in ("html", "body"):
            for one in value.split():
                if not (in_article and one in ("header", "article-header", "post-header", "entry-header")):
                    found = max(found, _word_role(one, tag in ("article", "main")))
    return found


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order, with white space turned into single spaces; blocks without text are left out."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool, int]] = [("", 0, 0, False, 0)]  # tag, role, article, link, owner
    depth: Counter = Counter()  # of each tag in the stack
    parts: list[str] = []
    linked = articles = owners = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                _, bad, article, _, owner = stack[-1]
                heading = any(re.fullmatch("h[1-6]", x[0]) for x in stack[-3:])
                out.append(Block(text, linked, bad, owner, article, heading))
            parts.clear()
        linked = 0

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        m = _TOKEN.match(page, lt) if lt >= 0 else None
        if lt < 0 or lt > at or m is None:
            end = len(page) if lt < 0 else lt if lt > at else lt + 1
            piece = page[at:end]
            parts.append(piece)
            if stack[-1][3]:
                linked += len(piece.strip())
            at = end
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in BLOCK or tag in ("br", "p"):
                flush()
            if depth[tag]:
                while stack[-1][0] != tag:
                    depth[stack.pop()[0]] -= 1
                depth[stack.pop()[0]] -= 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                found = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = found.end() if found else len(page)
            if tag == "title":
                flush()
            continue
        if tag in BLOCK:
            flush()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # their end tags may be missing
                k = len(stack) - 1
                while k and stack[k][0] not in BLOCK:
                    k -= 1
                if stack[k][0] == tag:
                    depth.subtract(x[0] for x in stack[k:])
                    del stack[k:]
            elif any(x[0] == "p" for x in stack[-4:]):
                k = len(stack) - 1
                while stack[k][0] != "p" and stack[k][0] not in BLOCK:
                    k -= 1
                if stack[k][0] == "p":
                    depth.subtract(x[0] for x in stack[k:])
                    del stack[k:]
        if tag in VOID:
            continue
        _, bad, article, link, owner = stack[-1]
        role = _role(tag, attrs, bool(article))
        if tag in ("article", "main") and not article and max(bad, role) < 2:
            articles += 1
            article = articles
        if attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if role == 2 and not owner:
            owners += 1
            owner = owners
        stack.append((tag, max(bad, role), article, link or tag == "a", owner))
        depth[tag] += 1
    flush()
    return out


def _stops(text: str) -> tuple[int, int]:
    """Numbers of stop words and of words."""
    words = [w for w in (_TRIM.sub("", x) for x in text.lower().split()) if w]
    return sum(w in STOP for w in words), len(words)


def _decide(b: Block, stops: float, passed: int) -> str:
    """The first pass; `passed` is the owner whose role is passed over."""
    if b.bad >= 2 and not (b.bad == 2 and b.owner == passed) or b.linked > LINKS_MOST * len(b.text):
        return "bad"
    if b.bad == 1 and not (len(b.text) >= LONG and stops >= STOP_SOME and not b.linked):
        return "bad"
    if b.text.startswith("©") and len(b.text) < LONG and not b.article:
        return "bad"
    if len(b.text) < SHORT or b.heading:
        return "short"
    if b.article:
        return "good" if stops >= STOP_SOME else "short"
    if len(b.text) >= LONG:
        if stops >= STOP_SOME and not b.linked or stops >= STOP_MANY:
            return "good"
        return "short" if stops >= STOP_FEW else "bad"
    return "good" if stops >= STOP_MANY and not b.linked else "short"


def label(blocks: list[Block], passed: int = 0) -> list[Block]:
    """Set every block's label to good or bad."""
    counts = [_stops(b.text) for b in blocks]
    prose = [n for n, b in zip(counts, blocks, strict=True) if (b.bad < 2 or b.bad == 2 and b.owner == passed) and not b.linked and len(b.text) >= LONG]
    known = not prose or sum(n for n, _ in prose) >= STOP_NONE * sum(n for _, n in prose)
    for b, (n, words) in zip(blocks, counts, strict=True):
        # of another language: what ends as a sentence counts as prose, what doesn't as a list
        b.label = _decide(b, n / max(1, words) if known else float(bool(_SENTENCE.search(b.text))), passed)
    decided = [b.label for b in blocks]
    before: list[tuple[int, str] | None] = []
    last: dict[int, tuple[int, str]] = {}
    for i, b in enumerate(blocks):
        before.append(last.get(b.article))
        if decided[i] != "short" and not (b.article and decided[i] == "bad"):
            last[b.article] = (i, decided[i])
    last = {}
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if decided[i] == "short":
            x, y = before[i], last.get(b.article)
            if x is None and y is None:
                b.label = "good" if b.article else "bad"
            elif x is None or y is None:
                b.label = (x or y)[1]
            elif b.heading and not b.article:
                b.label = y[1]
            else:
                dx, dy = i - x[0], y[0] - i
                b.label = x[1] if dx < dy else y[1] if dy < dx else x[1] if x[1] == y[1] else "good" if b.article else "bad"
        elif not (b.article and decided[i] == "bad"):
            last[b.article] = (i, decided[i])
    return blocks


def main_text(page: str | None) -> str:
    blocks = blocks_of(page)
    found = [b.text for b in label(blocks) if b.label == "good"]
    if not found:  # without any text, the role word is passed over that has most of the prose
        prose: Counter = Counter()
        for b in blocks:
            if b.bad == 2 and len(b.text) >= LONG:
                prose[b.owner] += len(b.text) - b.linked
        if prose:
            found = [b.text for b in label(blocks, max(prose, key=lambda k: (prose[k], -k))) if b.label == "good"]
    return "\n".join(found)


def plain_text(page: str | None) -> str:
    """Every block, boilerplate or not, a line each."""
    return "\n".join(b.text for b in blocks_of(page))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["__id", "__url", "text", "n_chars"])

    a, b = (pages.schema[c].dataType.simpleString() for c in (id_column, url_column))
    out = pages.selectExpr(f"`{id_column}` as __id", f"`{url_column}` as __url", f"cast(`{html_column}` as string) as __html")
    return out.mapInArrow(run, f"__id {a}, __url {b}, text string, n_chars bigint").withColumnsRenamed({"__id": id_column, "__url": url_column})
