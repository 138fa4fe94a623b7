"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read once into its leaf blocks: runs of text between block-level tags, each with its ancestors, their tags, classes and
ids. Scripts, styles, templates, the head, comments, hidden elements, what is typed into a textarea
and the source in an iframe are never text; formulas, drawings' labels and fallback text are. The field labels each block
main or not from ancestor-tag features, text features (length, links, digits, sentence ends), words of classes and ids with their
parts of three letters, and where the block stands: the core is the article that has the most running text, or else the innermost container with most of it, and a block is outside of it, in it, or in
a container of its own within it, of so much of the text, so many links, and so many alike beside it. A pair of labels has a weight too, so that the context of a block counts. It is trained by
stochastic gradient steps on the exact likelihood (forward-backward) over labelled pages and decoded by Viterbi.

The labelled pages are by default made by ``labelled_pages``: pages of known main text in many layouts, with
menus, headers, footers, sidebars, notices, adverts, forms and comments around and inside it. On half of them all class and id words
are made up, so that the field learns what structure alone tells. Others can be given. Their number is a parameter; the model is a small table of weights and is sent to the tasks.

Defined cases: null or empty html has the empty text; html without tags is one block; unclosed and
wrongly closed tags are mended as browsers mostly do; what follows an unclosed script, style or comment is
dropped with it; repeated rows are read alike; an empty table gives no rows; long pages are read whole;
other columns pass by name.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import beside, map_batches, packed, packed_kind

PAGES, ROUNDS, STEP, SEED = 1000, 10, 0.3, 7

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN_TAGS = frozenset("script style template head iframe textarea".split())
RAW_TAGS = frozenset("script style textarea title iframe".split())
#: Opening one of these closes an open one of the others.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Lists and cells of an outer list or table stay open.
STOPS = frozenset("ul ol dl table select body html div article section main td".split())
#: Block-level tags that end an open paragraph.
ENDS_P = BLOCK_TAGS - frozenset("button label option caption legend".split())

_TAG = re.compile(r"""<!--|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_MAYBE_HIDDEN = re.compile(r"hidden|display", re.I)
_NOT_DISPLAYED = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")


@dataclass(slots=True)
class Block:
    text: str
    tags: tuple[str, ...]
    names: frozenset[str]
    linked: int = 0
    path: tuple[_Open, ...] = ()


class _Open:
    __slots__ = ("tag", "names", "unseen")

    def __init__(self, tag: str, names: tuple[str, ...], unseen: bool):
        self.tag, self.names, self.unseen = tag, names, unseen


def _is_hidden(attributes: str) -> bool:
    """Whether a tag has the attribute ``hidden`` or a style that displays nothing."""
    if not _MAYBE_HIDDEN.search(attributes):
        return False
    own: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        own.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return "hidden" in own or bool(_NOT_DISPLAYED.search(own.get("style", "")))


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks with text, in page order; white space in each is one space."""
    page = page or ""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked = links = unseen = 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(dict.fromkeys(o.tag for o in stack)), frozenset(n for o in stack for n in o.names), linked, tuple(stack)))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal links, unseen
        if any(o.tag in BLOCK_TAGS for o in stack[k:]):
            close()
        for o in stack[k:]:
            links -= o.tag == "a"
            unseen -= o.unseen
        del stack[k:]

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not unseen:
            text = page[at : m.start()]
            parts.append(text)
            linked += len(text) if links else 0
        at = m.end()
        if m[0] == "<!--":
            stop = page.find("-->", at)
            at = end if stop < 0 else stop + 3
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "br":
                parts.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in VOID_TAGS:
            if tag == "hr":
                close()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in RAW_TAGS:
            stop = re.compile(rf"</{tag}[\s/>]|</{tag}$", re.I).search(page, at)
            if tag in UNSEEN_TAGS or unseen:
                at = end if stop is None else (page.find(">", stop.start()) + 1 or end)
                continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag in BLOCK_TAGS:
                    break
        for k in range(len(stack) - 1, -1, -1) if tag in CLOSES else ():
            if stack[k].tag in CLOSES[tag]:
                pop_to(k)
                break
            if stack[k].tag in STOPS:
                break
        if tag == "body" and unseen:
            pop_to(next((k for k, o in enumerate(stack) if o.tag in UNSEEN_TAGS), len(stack)))
        if tag in BLOCK_TAGS:
            close()
        if attributes.rstrip().endswith("/") and tag not in BLOCK_TAGS and tag not in UNSEEN_TAGS:
            continue
        names = tuple(w for g in _NAMES.findall(attributes) for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(g)).lower())) if "=" in attributes else ()
        stack.append(_Open(tag, names, tag in UNSEEN_TAGS or _is_hidden(attributes)))
        links += tag == "a"
        unseen += stack[-1].unseen
    if at < end and not unseen:
        parts.append(page[at:])
        linked += end - at if links else 0
    close()
    return out


#: Elements that hold parts of a page.
CONTAINERS = frozenset("html body div section article main td aside nav header footer form ul ol dl table blockquote details figure fieldset center".split())
#: Words that a block of running text has; the share of it that the core holds.
RUNNING, CORE = 8, 0.6
#: The share of the running text that the fullest of several article or main elements must hold to be the core.
SAID = 0.2


@lru_cache(maxsize=1 << 14)
def _parts(name: str) -> tuple[str, ...]:
    """A class or id word, and its parts of three letters."""
    whole = f"^{name}$"
    return (f"name={name}", *(f"part={whole[i : i + 3]}" for i in range(len(whole) - 2)))


def _step(share: float) -> int:
    """A share in five steps."""
    return (share > 0) + (share > 0.1) + (share > 0.3) + (share > 0.6)


def features(found: list[Block]) -> list[list[str]]:
    """The active features of each block."""
    # How much running text, text and link text, and which blocks each element holds.
    running, chars, linked, first, last = ({} for _ in range(5))
    words = [b.text.count(" ") + 1 for b in found]
    runs = [len(b.text) if n >= RUNNING and b.linked * 2 < len(b.text) else 0 for b, n in zip(found, words, strict=True)]
    total = sum(runs)
    for i, b in enumerate(found):
        for o in b.path:
            running[o] = running.get(o, 0) + runs[i]
            chars[o] = chars.get(o, 0) + len(b.text)
            linked[o] = linked.get(o, 0) + b.linked
            first.setdefault(o, i)
            last[o] = i
    core, place = None, -1
    named = {o: k for b in found for k, o in enumerate(b.path) if o.tag in ("article", "main")}
    said = max(named, key=lambda o: (running[o], chars[o] - linked[o], -first[o], named[o]), default=None)
    if said is not None and (len({first[o] for o in named}) == 1 or running[said] >= SAID * total):
        core, place = said, named[said]
    else:
        for b in found:
            for k, o in enumerate(b.path):
                if k > place and o.tag in CONTAINERS and running[o] >= CORE * total:
                    core, place = o, k
    # Containers right below the core, and how many of a kind there are.
    below = [next((o for o in b.path[place + 1 :] if o.tag in CONTAINERS), None) if core and len(b.path) > place and b.path[place] is core else None for b in found]
    alike: dict[tuple, set] = {}
    inner: list[_Open | None] = []
    for b, o in zip(found, below, strict=True):
        # The innermost element with a name of its own, below that container or outside of the core.
        inner.append(next((x for x in reversed(b.path) if x.names and x is not o and x is not core and x.tag in BLOCK_TAGS), None) if o is not None else None)
        for x in {o, inner[-1]} - {None}:
            alike.setdefault((x.tag, x.names), set()).add(x)
    out = []
    for i, b in enumerate(found):
        n = len(b.text)
        own = b.tags[-1] if b.tags else ""
        share = min(4, 4 * b.linked // n)
        f = ["bias", f"own={own}", f"words={min(words[i], 64).bit_length()}", f"links={share}"]
        f += [f"tag={t}" for t in b.tags]
        f += [x for w in b.names for x in _parts(w)]
        f.append("stop" if b.text[-1] in ".!?:…\"'”" else "nostop")
        if sum(map(b.text.count, "0123456789")) * 5 > n:
            f.append("digits")
        if b.text[0] in "©":
            f.append("copyright")
        for side, j in (("before", i - 1), ("after", i + 1)):
            f.append(f"{side}={min(4, 4 * found[j].linked // len(found[j].text))}/{min(words[j], 64).bit_length()}" if 0 <= j < len(found) else f"{side}=none")
        if core is None or len(b.path) <= place or b.path[place] is not core:
            where = "none" if core is None else "above" if i < first[core] else "under" if i > last[core] else "among"
            f += [f"out={where}", f"out_own={where}/{own}", f"out_links={where}/{share}"]
        elif (o := below[i]) is None:
            f += ["in", f"in_own={own}", f"in_links={share}", f"in_core={core.tag}"]
        else:
            held, links, many = _step(running[o] / max(total, 1)), min(4, 4 * linked[o] // chars[o]), min(3, len(alike[o.tag, o.names]))
            at = "first" if first[o] == first[core] else "last" if last[o] == last[core] else "middle"
            deeper = sum(x.tag in CONTAINERS for x in b.path[place + 2 :])
            within = min(3, len(alike[inner[i].tag, inner[i].names])) if inner[i] is not None else 0
            kind = f"{o.tag}/{'named' if o.names else 'bare'}"
            f += [f"part_of={kind}", f"part_held={kind}/{held}", f"part_links={kind}/{links}", f"part_at={kind}/{at}", f"part_at={kind}/{at}/{held}", f"alike={many}/{bool(o.names)}", f"deeper={min(deeper, 3)}", f"part_own={own}/{held}", f"inner={within}", f"inner={within}/{at}"]
            f += [x.replace("=", "_in=", 1) for w in o.names for x in _parts(w)]
        out.append(f)
    return out


class Crf:
    """Two labels, a weight for each feature, and one for each pair of neighbouring labels."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.pairs = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, feats: list[list[str]]) -> list[float]:
        """How much label 1 gains over label 0 at each block."""
        get = self.weights.get
        return [sum(get(f, 0.0) for f in own) for own in feats]

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The best labels, by Viterbi."""
        if not feats:
            return []
        (p00, p01), (p10, p11) = self.pairs
        gains = self.scores(feats)
        a, b, back = 0.0, gains[0], []
        for g in gains[1:]:
            from0, from1 = a + p00 >= b + p10, a + p01 >= b + p11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = max(a + p00, b + p10), max(a + p01, b + p11) + g
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def marginals(self, gains: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of label 1, and of each pair of labels summed over neighbours."""
        n, pairs = len(gains), np.array(self.pairs)
        emit = np.stack((np.zeros(n), np.array(gains)), axis=1)
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        fwd[0] = emit[0]
        for i in range(1, n):
            x = fwd[i - 1][:, None] + pairs
            fwd[i] = np.logaddexp(x[0], x[1]) + emit[i]
        for i in range(n - 2, -1, -1):
            x = pairs + (emit[i + 1] + bwd[i + 1])[None, :]
            bwd[i] = np.logaddexp(x[:, 0], x[:, 1])
        z = np.logaddexp(*fwd[-1])
        one = np.exp(fwd[:, 1] + bwd[:, 1] - z)
        both = np.zeros((2, 2))
        if n > 1:
            both = np.exp(fwd[:-1, :, None] + pairs + (emit[1:] + bwd[1:])[:, None, :] - z).sum(axis=0)
        return one, both

    def fit(self, pages: Iterable[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS, step: float = STEP, decay: float = 1e-4) -> Crf:
        """Gradient steps on the likelihood of the labels, with a step for each weight that shrinks as it moves (AdaGrad)."""
        pages = [p for p in pages if p[0]]
        moved: dict[str, float] = {}
        moved_pairs = np.full((2, 2), 1e-6)
        for _ in range(rounds):
            for feats, labels in pages:
                one, both = self.marginals(self.scores(feats))
                grads: dict[str, float] = {}
                for own, y, p in zip(feats, labels, one.tolist(), strict=True):
                    for f in own:
                        grads[f] = grads.get(f, 0.0) + y - p
                for f, g in grads.items():
                    w = self.weights.get(f, 0.0)
                    g -= decay * w
                    moved[f] = moved.get(f, 1e-6) + g * g
                    self.weights[f] = w + step * g / math.sqrt(moved[f])
                seen = np.zeros((2, 2))
                for a, b in zip(labels, labels[1:], strict=False):
                    seen[a, b] += 1
                g2 = seen - both
                moved_pairs += g2 * g2
                self.pairs = (np.array(self.pairs) + step * g2 / np.sqrt(moved_pairs)).tolist()
        return self


#: Names that layouts give to what is, and what is not, main text.
MAIN_NAMES = "content article post entry story main body text article-body post-content entry-content page-content maintext article__body richtext".split()
ASIDES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar main-menu pagination pager toc".split(),
    "header": "header masthead site-header banner topbar branding logo".split(),
    "footer": "footer site-footer copyright legal colophon bottom".split(),
    "aside": "sidebar aside related widget recommended popular trending more-stories rail".split(),
    "notice": "notice cookie cookie-notice consent gdpr alert warning message popup modal overlay".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adbox banner-ad".split(),
    "form": "form search login newsletter subscribe signup contact-form".split(),
    "comments": "comments comment comment-list reply replies discussion disqus responses reader-comments".split(),
    "share": "share social sharing toolbar tags meta byline author-box".split(),
}


_ATTR = re.compile(r'(class|id)="([^"]*)"')


def labelled_pages(n: int = PAGES, seed: int = SEED) -> Iterator[tuple[str, list[str]]]:
    """Pages and the texts of their main blocks, in page order; on every other page all names are made up."""
    rnd = random.Random(seed)
    letters = "aeiourstnlmdcpé"
    word = lambda: "".join(rnd.choices(letters, k=rnd.randint(2, 9)))
    noise = lambda w: w + rnd.choice(["***", "###", "%%%", "$$$"])

    def sentence(dirty: bool) -> str:
        ws = [word() for _ in range(rnd.choice([1, 3, 8, 15, 25]))]
        return " ".join(map(noise, ws) if dirty else ws).capitalize() + rnd.choice([".", ".", ".", "", "!", "?"])

    def prose(dirty: bool) -> str:
        return " ".join(sentence(dirty) for _ in range(rnd.choice([1, 1, 2, 4, 7])))

    def aside(kind: str) -> str:
        name = rnd.choice(ASIDES[kind])
        attr = rnd.choice(['class="{}"', 'id="{}"', 'class="box {}"', 'class="{} x1"']).format(name)
        own = {"nav": ["nav", "div", "ul", "nav"], "header": ["header", "div", "header"], "footer": ["footer", "div", "footer"], "aside": ["aside", "div", "section"], "form": ["form", "div"], "comments": ["div", "section", "div", "ol"]}
        tag = rnd.choice(own.get(kind, ["div", "div", "section"]))
        if tag in own.get(kind, [])[:1] and tag not in ("div", "ul") and rnd.random() < 0.5:
            attr = ""
        if kind in ("nav", "share") or (kind in ("aside", "footer", "header") and rnd.random() < 0.4):
            item = "".join(f'<li><a href="/{word()}">{" ".join(word() for _ in range(rnd.randint(1, 4)))}</a></li>' for _ in range(rnd.randint(2, 7)))
            inner = item if tag in ("ul", "ol") else f"<ul>{item}</ul>"
        elif kind == "form":
            inner = f'<label>{word()}</label><input type="text"><button>{word()}</button>' + (f"<p>{sentence(False)}</p>" if rnd.random() < 0.5 else "")
        elif kind == "comments":
            if rnd.random() < 0.5:
                # Each with its writer, and paragraphs of its own.
                by, item, own = rnd.choice(["b", "span", "cite", "h4", "a"]), rnd.choice(["div", "li", "article", "section"]), rnd.choice([f' class="{rnd.choice(ASIDES["comments"])}"', f' class="{word()}"', ""])
                one = lambda: f"<{item}{own}><{by}>{word()}</{by}>" + "".join(f"<p>{prose(False)}</p>" for _ in range(rnd.choice([1, 1, 2]))) + f"</{item}>"
                items = "".join(one() for _ in range(rnd.randint(1, 6)))
                head = rnd.choice([f"<h3>{word()}</h3>", f"<h3>{rnd.randint(1, 99)} {word()}</h3>", f"<h2>{sentence(False)}</h2>", ""])
                return f"<{tag} {attr}>{head}{items if tag != 'ol' or item == 'li' else '<li>' + items + '</li>'}</{tag}>".replace(" >", ">")
            inner = rnd.choice([f"<h3>{word()}</h3>", f"<h3>{word()}</h3>", ""]) + "".join(f'<{rnd.choice(["div", "li", "p"])} class="{rnd.choice(ASIDES["comments"])}">{prose(False)}' + rnd.choice(["", "<p>" + prose(False)]) for _ in range(rnd.randint(1, 5)))
            inner = re.sub(r"<(div|li|p) class=\"([\w-]+)\">([^<]*(?:<p>[^<]*)?)", r'<\1 class="\2">\3</\1>', inner)
        elif kind == "footer":
            inner = rnd.choice([f"&copy; {word()}.example &middot; {prose(False)}", f"<div>Copyright {rnd.randint(1999, 2030)} {word()} {word()}</div><div><a href='/'>{word()}</a></div>", f"<p>{sentence(False)}</p><p><a href='/'>{word()}</a></p>"])
        elif rnd.random() < 0.4:
            linked = " ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(rnd.randint(1, 3)))
            head = rnd.choice(["", f"<h3>{word()} {word()}</h3>", f"<div>{word()} {word()}</div>"])
            inner = f"{head}<p>{sentence(False)}</p>" + rnd.choice(["", f"<p>{linked}</p>", f"<div>{linked}</div>", f"<p>{prose(False)}</p>"])
        else:
            inner = rnd.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<h4>t</h4><p>{}</p>"]).format(prose(False))
        return f"<{tag} {attr}>{inner}</{tag}>".replace(" >", ">")

    for number in range(n):
        main: list[str] = []
        dirty_page = rnd.random() < 0.2

        def keep(text: str, into: list[str] = main) -> str:
            into.append(text)
            return html_lib.escape(text, quote=False)

        body = [f"<h1>{keep(sentence(dirty_page))}</h1>"] if rnd.random() < 0.9 else []
        for _ in range(rnd.randint(1, 12)):
            x = rnd.random()
            if x < 0.6:
                body.append(f"<p>{keep(prose(dirty_page))}</p>")
            elif x < 0.68:
                a = sentence(dirty_page)
                body.append(f"<p><b>{keep(a)}<br><p>{keep(prose(dirty_page))}</p>")
            elif x < 0.74:
                body.append(f"<h2>{keep(sentence(dirty_page))}</h2>")
            elif x < 0.8:
                body.append("<ul>" + "".join(f"<li>{keep(sentence(dirty_page))}</li>" for _ in range(rnd.randint(1, 4))) + "</ul>")
            elif x < 0.84:
                body.append(f"<blockquote><p>{keep(prose(dirty_page))}</p></blockquote>")
            elif x < 0.88:
                body.append("<table>" + "".join(f"<tr><td>{keep(word())}</td><td>{keep(str(rnd.randint(1, 9999)))}</td></tr>" for _ in range(2)) + "</table>")
            elif x < 0.92:
                body.append(f"<div>{keep(prose(dirty_page))}</div>")
            else:
                body.append(aside(rnd.choice(["ad", "notice", "share", "form", "aside", "nav"])))
        if rnd.random() < 0.15 and len(body) > 2:
            # The text itself in a container, bare or named, or in sections with headings.
            tag = rnd.choice(["div", "section"])
            if rnd.random() < 0.5:
                body = [body[0], f'<{tag} class="{rnd.choice(MAIN_NAMES)}">{"".join(body[1:])}</{tag}>']
            else:
                half = len(body) // 2
                body = [f"<{tag}>{''.join(part)}</{tag}>" for part in (body[:half], body[half:])]
        if rnd.random() < 0.35:
            body.append(aside("comments"))
        box = rnd.choice(["article", "article", "article", "main", "div", "section", "main-article", "div-article", "td"])
        name = rnd.choice(MAIN_NAMES)
        inner = "".join(body)
        if box in ("article", "main"):
            attr = f' class="{name}"' if rnd.random() < 0.3 else ""
            core = f"<{box}{attr}>{inner}</{box}>"
        elif box == "main-article":
            core = f"<main><article>{inner}</article>{aside(rnd.choice(['aside', 'comments', 'ad']))}</main>"
        elif box == "div-article":
            core = f'<div class="{rnd.choice(["container", "wrapper", "page", "row"])}"><article>{inner}</article></div>'
        elif box == "td":
            core = f'<table><tr><td>{aside("nav")}</td><td class="{name}">{inner}</td></tr></table>'
        else:
            core = f'<{box} {rnd.choice(["class", "id"])}="{name}">{inner}</{box}>'
        before = "".join(aside(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if rnd.random() < 0.45)
        after = "".join(aside(k) for k in ("comments", "aside", "ad", "form", "share", "notice", "footer") if rnd.random() < 0.4)
        if rnd.random() < 0.3:
            outer = word()
            before, after = f'<div class="{outer}">{before}', f"{after}</div>"
        page = f"{before}{core}{after}"
        if number % 2:
            made: dict[str, str] = {}
            page = _ATTR.sub(lambda m: f'{m[1]}="' + " ".join(made.setdefault(w, word() + rnd.choice(["", "", "-" + word()])) for w in m[2].split()) + '"', page)  # noqa: B023
        yield f"<html><head><title>{word()}</title><style>p{{}}</style></head><body>{page}</body></html>", main


def label(page: str, main: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a labelled page: a block is main if it is the next of the main texts."""
    found, k, labels = blocks(page), 0, []
    rest = [" ".join(t.split()) for t in main]
    for b in found:
        hit = k < len(rest) and b.text == rest[k]
        labels.append(int(hit))
        k += hit
    return features(found), labels


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = SEED) -> Crf:
    return Crf().fit(label(*p) for p in labelled_pages(pages, seed))


def extract_text(page: str | None, model: Crf) -> str:
    """The main blocks, joined by one space."""
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, model.decode(features(found)), strict=True) if y)


def extract(pages: DataFrame, keep: list[str], html: str = "html", model: Crf | None = None) -> DataFrame:
    """``pages``' columns ``keep`` with ``html_main``, the main text."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())
    given = packed(pages, keep, F.col(html).alias("html_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = [extract_text(x.as_py(), m) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], ["kept", "html_main"])

    return beside(map_batches(given, run, packed_kind(given, "html_main string")), keep)
