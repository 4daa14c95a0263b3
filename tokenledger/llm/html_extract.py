"""Main-text extraction: a linear-chain conditional random field over the leaf
blocks of a page.

``blocks_of`` walks the markup once and yields its leaf blocks in page order:
the text between two block-level tags, white space made single, character
references decoded, with the open tags and their class and id words.  Scripts,
styles, text fields, frames, comments and descriptions of drawings give no
blocks, all other text does; unclosed and truncated markup is taken as browsers
do, and a quote opens a value only straight after its equals sign.  Features are ancestor tags, class words, lengths, links and
punctuation; the field has the states boilerplate and content, is trained by
gradient ascent on labelled pages and decoded by Viterbi.

The labelled pages are laid out by ``labelled_pages``: articles in several kinds
of containers with menus, headers, sidebars, notices, adverts, forms, related
links and reader comments around and between, in invented words, so the field
learns places and shapes, not words.  Training takes a second on the driver and
the field (some hundred weights) is broadcast.

Cases: a null or empty page, or one without content, gives an empty text;
repeated rows each get their row; whole pages are read whatever their length;
extra columns are not read.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tokenledger.llm import arrow_text as at

#: fixed values: elements of HTML that end a line of text, that hold no
#: readable text, and that have no content
BLOCK = frozenset("""address article aside blockquote body button canvas caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu
nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
RAW = frozenset("script style textarea iframe".split())
#: elements with XML rules inside (a tag may end itself), and what in them describes a drawing and is not shown
FOREIGN, UNSEEN = frozenset(("svg", "math")), frozenset(("title", "desc", "metadata"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: a begin tag of the key closes an open element of the value
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "tags", "hints", "link")

    def __init__(self, text, tags, hints, link):
        self.text, self.tags, self.hints, self.link = text, tags, hints, link


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []   # open block-level elements with their hints
    parts: list[str] = []
    inside_link = link = at_ = foreign = 0

    def flush():
        nonlocal link
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(t for t, _ in stack), tuple(h for _, hs in stack for h in hs), link))
        parts.clear()
        link = 0

    while True:
        m = _TOKEN.search(page, at_)
        text = page[at_:m.start() if m else len(page)]
        if text:
            parts.append(text)
            if inside_link:
                link += len(text.strip())
        if not m:
            break
        at_ = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        ended = not closing and (m[3] or m[6] or "").endswith("/")
        if name in FOREIGN:
            foreign = max(0, foreign - 1) if closing else foreign + (not ended)
            continue
        if name == "br" or name in BLOCK and name not in UNSEEN:
            foreign = 0  # no such element stands in a drawing or formula
        if foreign and (ended or name in UNSEEN):
            end = None if ended or closing else re.compile(rf"</{name}\s*>", re.I).search(page, at_)
            at_ = end.end() if end else at_
            continue
        if name in RAW and not closing:
            end = re.compile(rf"</{name}\s*>?", re.I).search(page, at_)
            at_ = end.end() if end else len(page)
            if end and page[at_ - 1] != ">":
                at_ = (page.find(">", at_) + 1) or len(page)
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            inside_link = 0 if closing else 1
        elif name in BLOCK:
            flush()
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name not in VOID:
                if stack and stack[-1][0] == "p":
                    stack.pop()
                while stack and stack[-1][0] in CLOSES.get(name, ()):
                    stack.pop()
                attributes = m[3] or m[6] or ""
                hints = tuple(w for g in _NAMED.findall(attributes) for w in _WORD.findall("".join(g).lower())) \
                    if attributes else ()
                stack.append((name, hints))
            inside_link = 0
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the binary features of each block."""
    rows = []
    total = len(blocks)
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        rows.append([
            "bias", *{"a:" + t for t in b.tags}, *{"h:" + h for h in b.hints},
            "p:" + (b.tags[-1] if b.tags else "-"), f"w:{min(words.bit_length(), 8)}",
            f"l:{min(4, 4 * b.link // max(1, len(b.text)))}",
            "e:" + (b.text[-1] if b.text[-1] in ".!?:;,\"" else "-"),
            f"c:{min(3, b.text.count(','))}", f"s:{min(4, b.text.count('. ') + b.text.count('.' + chr(34)))}",
            "sign" if b.text[0] in "©®™»›|•" else "plain",
            f"at:{min(4, 5 * k // total)}"])
    return rows


class Field:
    """Weights of the field: ``emit`` per feature (content against
    boilerplate), ``step`` per pair of states."""

    def __init__(self, emit: dict[str, float], step: np.ndarray) -> None:
        self.emit, self.step = emit, step

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the likeliest states."""
        get = self.emit.get
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b, back = 0.0, 0.0, []
        for k, row in enumerate(rows):
            d = sum(get(f, 0.0) for f in row)
            if k:
                from_a, from_b = a + s01, b + s11
                to_a, to_b = a + s00, b + s10
                back.append((to_b > to_a, from_b > from_a))
                a, b = max(to_a, to_b), max(from_a, from_b) + d
            else:
                b = d
        state = int(b > a)
        out = [state]
        for choice in reversed(back):
            state = int(choice[state])
            out.append(state)
        return out[::-1]


def train(pages: list[tuple[str, set[str]]], rounds: int = 150, penalty: float = 0.02) -> Field:
    """Maximum likelihood with a quadratic penalty.  ``pages``: (html, texts of
    its content blocks)."""
    rows, states, first = [], [], []
    for page, content in pages:
        blocks = blocks_of(page)
        first += [True] + [False] * (len(blocks) - 1)
        rows += features(blocks)
        # the page's title repeats the headline outside the content
        states += [int(b.text in content and "head" not in b.tags) for b in blocks]
    names = {f: k for k, f in enumerate(sorted({f for r in rows for f in r}))}
    flat = np.array([names[f] for r in rows for f in r])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    y = np.array(states)
    first = np.array(first)
    begins = np.flatnonzero(first)
    length = np.diff(np.append(begins, len(rows)))
    order = np.argsort(-length, kind="stable")
    begins, length = begins[order], length[order]
    w, step = np.zeros(len(names)), np.zeros((2, 2))
    gw, gs = np.full(len(names), 1e-8), np.full((2, 2), 1e-8)
    follow = np.flatnonzero(~first)
    seen_step = np.zeros((2, 2))
    np.add.at(seen_step, (y[follow - 1], y[follow]), 1)
    seen = np.bincount(flat, y[owner], len(names))
    for _ in range(rounds):
        d = np.bincount(owner, w[flat], len(rows))
        score = np.column_stack([np.zeros(len(rows)), d])
        # forward and backward over all pages side by side, longest first
        fwd, bwd = np.zeros((len(rows), 2)), np.zeros((len(rows), 2))
        fwd[begins] = score[begins]
        for t in range(1, int(length.max())):
            on = begins[length > t] + t
            fwd[on] = np.logaddexp.reduce(fwd[on - 1][:, :, None] + step[None], axis=1) + score[on]
        for t in range(int(length.max()) - 2, -1, -1):
            on = begins[length > t + 1] + t
            bwd[on] = np.logaddexp.reduce(step[None] + (score[on + 1] + bwd[on + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(fwd + bwd, axis=1)
        p1 = np.exp(fwd[:, 1] + bwd[:, 1] - total)
        pair = np.exp(fwd[follow - 1][:, :, None] + step[None] + (score[follow] + bwd[follow])[:, None, :]
                      - total[follow][:, None, None]).sum(0)
        g = seen - np.bincount(flat, p1[owner], len(names)) - penalty * w
        s = seen_step - pair - penalty * step
        gw, gs = gw + g * g, gs + s * s
        w, step = w + 0.5 * g / np.sqrt(gw), step + 0.5 * s / np.sqrt(gs)
    return Field({f: float(w[k]) for f, k in names.items()}, step)


def labelled_pages(count: int = 240, seed: int = 11) -> list[tuple[str, set[str]]]:
    """Pages with the texts of their content blocks."""
    rng = random.Random(seed)
    syllables = "ka lo mi ten sur va pel dor ni esh un tra gol bi fen ous ar qui zet om".split()

    def word():
        return "".join(rng.choices(syllables, k=rng.randint(1, 3)))

    def sentence(n=None):
        w = [word() for _ in range(n or rng.randint(4, 18))]
        if len(w) > 6 and rng.random() < 0.5:
            w[len(w) // 2] += ","
        return " ".join(w).capitalize() + rng.choice([".", ".", ".", "?", "!"])

    def phrase():
        return " ".join(word() for _ in range(rng.randint(1, 4))).capitalize()

    def para():
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))

    pages = []
    for _ in range(count):
        content: set[str] = set()

        def keep(text):
            content.add(" ".join(text.split()))
            return text

        def menu():
            return "<ul>" + "".join(f'<li><a href="/{word()}">{phrase()}</a></li>' for _ in range(rng.randint(3, 8))) + "</ul>"

        def box(names, inner):
            tag = rng.choice(["div", "section", "aside"])
            return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(names)}">{inner}</{tag}>'

        def noise():
            kind = rng.randrange(7)
            if kind == 0:
                return box(["ad", "ads", "advert", "promo banner", "sponsored ad"], rng.choice([sentence(), f"<p>{sentence()}</p>"]))
            if kind == 1:
                return box(["sidebar", "related", "widget related", "side bar"], f"<h3>{phrase()}</h3>{menu()}")
            if kind == 2:
                return box(["cookie notice", "notice", "cookie banner", "alert notice"], f"<p>{sentence()}</p><button>{phrase()}</button>")
            if kind == 3:
                return f'<form action="/{word()}"><label>{phrase()}</label><input name="q"><button>{phrase()}</button><p>{sentence()}</p></form>'
            if kind == 4:
                return box(["share", "social share", "newsletter", "subscribe newsletter"], f"<p>{sentence()}</p>" + menu())
            if kind == 5:
                return f"<aside><h4>{phrase()}</h4><p>{para()}</p></aside>"
            return f"<nav>{menu()}</nav>"

        def comments():
            inner = "".join(f'<{t} class="{rng.choice(["comment", "comment reply", "reply"])}"><p>{para()}</p></{t}>'
                            for t in rng.choices(["div", "li", "article"], k=rng.randint(1, 4)))
            return box(["comments", "comment list", "discussion comments", "responses comments"], f"<h2>{phrase()}</h2>" + inner)

        def body_block():
            kind = rng.random()
            if kind < 0.08:
                return f"<p>{keep(phrase())}</p>"
            if kind < 0.70:
                return f"<p>{keep(para())}" + rng.choice(["</p>", "</p>", ""])
            if kind < 0.78:
                return f"<h2>{keep(phrase())}</h2>"
            if kind < 0.85:
                return "<ul>" + "".join(f"<li>{keep(sentence())}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
            if kind < 0.90:
                return f"<blockquote><p>{keep(para())}</p></blockquote>"
            if kind < 0.94:
                return "<table><tr>" + "".join(f"<td>{keep(phrase())}</td>" for _ in range(3)) + "</tr></table>"
            if kind < 0.97:
                a, b, c = sentence(), phrase(), sentence()
                keep(f"{a} {b} {c}")
                return f'<p>{a} <a href="/{word()}">{b}</a> {c}</p>'
            return f"<pre>{keep(sentence())}</pre>"

        title = sentence(rng.randint(3, 9))
        inside = [f"<h1>{keep(title)}</h1>"] if rng.random() < 0.9 else []
        if rng.random() < 0.4:
            inside.append(f"<p><b>{keep(para())}<br>")
        inside += [body_block() for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.2:
            inside.append(f"<p><b>{keep(phrase())}<br>")
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            inside.insert(rng.randint(1, len(inside)), noise())
        if rng.random() < 0.2:
            inside.append(comments())
        holder = rng.choice(["article"] * 5 + ["main", 'div class="content"', 'div class="post"', 'div id="main content"',
                                               'div class="article body"', 'div class="entry text"', "section", "div"])
        main = f"<{holder}>{''.join(inside)}</{holder.split()[0]}>"
        head = f'<head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style></head>'
        top = rng.choice(["", f"<header><a href='/'>{phrase()}</a><p>{sentence()}</p></header>",
                          f'<div class="header"><h2>{phrase()}</h2>{menu()}</div>', f"<header><nav>{menu()}</nav></header>"])
        top += f"<nav>{menu()}</nav>" if rng.random() < 0.6 else ""
        low = rng.choice([f"<footer>&copy; {word()} &middot; {sentence()}</footer>", f"<footer><p>{sentence()}</p>{menu()}</footer>",
                          f'<div class="footer"><p>&copy; {sentence()}</p></div>', ""])
        around = [noise() for _ in range(rng.choice([0, 1, 1, 2, 3]))]
        cut = rng.randint(0, len(around))
        page = f"<!DOCTYPE html><html>{head}<body>{top}{''.join(around[:cut])}{main}" \
               f"{comments() if rng.random() < 0.35 else ''}{''.join(around[cut:])}{low}"
        pages.append((page + rng.choice(["</body></html>", ""]), content))
    return pages


def main_text(page: str, field: Field) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, s in zip(blocks, field.decode(features(blocks))) if s)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and text: the main text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(train(labelled_pages()))

    def run(batches):
        field = shared.value
        for batch in at.slices(batches, html_col):
            text = [main_text(p or "", field) for p in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(text, pa.string())], [*keep, "text"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html_col).mapInArrow(run, f"{kinds}, text string")
