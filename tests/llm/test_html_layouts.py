"""Main text on layouts that the module doesn't make, with names that it doesn't know: precision and recall by block."""

import random

import pytest

from tessera.llm import html_extract

MAIN = "txtcol lede rdr colw copyblock storytxt readable primary".split()
FRAME = "hd ft rt lft strap util mast gnav subnav xtra tools".split()
SLOTS = {"ad": "adslot dfp bnr tile skyscraper mpu", "news": "newsltr optin mailbox", "talk": "respond thread feedback voices talkback", "links": "readnext morefrom seealso inread", "note": "strip ckbar toast gdprbar"}
WORDS = "harbour lantern meadow copper distant winter signal orchard velvet thunder granite whisper canyon ember drift maple anchor quiet marble ribbon".split()


def page(rnd):
    word = lambda: rnd.choice(WORDS)
    line = lambda k: " ".join(rnd.choices(WORDS, k=k)).capitalize()
    prose = lambda: " ".join(line(rnd.randint(6, 18)) + "." for _ in range(rnd.randint(1, 5)))
    main = []

    def keep(text):
        main.append(text)
        return text

    def slot(kind):
        name = rnd.choice(SLOTS[kind].split())
        inner = {
            "ad": lambda: f"<p>{line(rnd.randint(4, 12))}</p>", "news": lambda: f"<p>{line(7)}.</p><input><button>{word()}</button>", "note": lambda: f"<p>{line(9)}. <a href='#'>{word()}</a></p>",
            "links": lambda: f"<h4>{line(2)}</h4><ul>" + "".join(f"<li><a href='/{k}'>{line(5)}</a></li>" for k in range(rnd.randint(2, 6))) + "</ul>",
            "talk": lambda: f"<h3>{rnd.randint(1, 9)} {word()}</h3>" + "".join(f"<div class='itm'><b>{word()}</b><p>{prose()}</p></div>" for _ in range(rnd.randint(1, 5))),
        }[kind]()
        return f'<div {rnd.choice(["id", "class"])}="{name}">{inner}</div>'

    def text():
        parts = [f"<h1>{keep(line(5))}</h1>"]
        for _ in range(rnd.randint(3, 10)):
            x = rnd.random()
            if x < 0.75:
                parts.append(f"<p>{keep(prose())}</p>")
            elif x < 0.83:
                parts.append(f"<h2>{keep(line(3))}</h2><p>{keep(prose())}</p>")
            elif x < 0.9:
                parts.append("<ul>" + "".join(f"<li>{keep(line(8) + ".")}</li>" for _ in range(3)) + "</ul>")
            else:
                parts.append(slot(rnd.choice(["ad", "links", "news"])))
        return "".join(parts)

    links = lambda k: "".join(f'<a href="/{word()}">{word()}</a> ' for _ in range(k))
    a, b, c = rnd.sample(FRAME, 3)
    head = f'<div class="{a}"><div>{line(2)}</div><div>{links(5)}</div></div>'
    foot = f'<div class="{b}"><div>Copyright 2020 {line(3)}</div><div>{links(3)}</div></div>'
    side = f'<div class="{c}"><h3>{line(2)}</h3><p>{line(12)}.</p><p>{links(2)}</p></div>'
    shape, name = rnd.randrange(4), rnd.choice(MAIN)
    if shape == 0:
        core = f'<article>{text()}{slot("talk") if rnd.random() < 0.6 else ""}</article>{side}'
    elif shape == 1:
        core = f'<div class="row">{side if rnd.random() < 0.5 else ""}<div class="{name}">{text()}</div>{side}</div>'
    elif shape == 2:
        core = f'<div class="{name}">{text()}</div>{slot("talk")}'
    else:
        core = f"<div>{text()}</div>{side}"
    note = slot("note") if rnd.random() < 0.3 else ""
    return f"<html><body>{note}{head}{core}{foot}</body></html>", main


def measured(pages):
    model, right, found, wanted, whole = html_extract.trained(), 0, 0, 0, 0
    for source, main in pages:
        feats, labels = html_extract.label(source, main)
        got = model.decode(feats)
        right += sum(x and y for x, y in zip(got, labels, strict=True))
        found, wanted, whole = found + sum(got), wanted + len(main), whole + (got == labels)
    return right / found, right / wanted, whole / len(pages)


def test_names_are_unknown():
    known = {w for names in html_extract.ASIDES.values() for w in names} | set(html_extract.MAIN_NAMES)
    assert not known & {*MAIN, *FRAME, *(w for s in SLOTS.values() for w in s.split())}


def test_unseen_layouts():
    rnd = random.Random(5)
    precision, recall, whole = measured([page(rnd) for _ in range(200)])
    print(f"precision {precision:.4f} recall {recall:.4f} whole pages {whole:.3f}")
    assert precision >= 0.95 and recall >= 0.95


def test_pages_of_its_own_kind():
    precision, recall, _ = measured(list(html_extract.labelled_pages(150, 31)))
    print(f"precision {precision:.4f} recall {recall:.4f}")
    assert precision >= 0.95 and recall >= 0.95


P = "<p>Copper lantern drift along the quiet harbour, and the winter signal fades.</p>"


@pytest.mark.parametrize(("source", "gone"), [
    (f'<body><article><h1>Title here</h1>{P * 4}<section id="respond"><h3>Two replies</h3><p>I liked this text very much, thank you for it.</p></section></article></body>', "liked"),
    (f'<body><div class="hd"><a href="/">Site Name</a></div><div class="txtcol"><h1>Title here</h1>{P * 4}</div><div class="rt"><p>Buy one lamp now</p></div><div class="ft">Copyright 2020 Site Inc</div></body>', "Site Buy Copyright"),
    (f'<body><div><h1>Title here</h1>{P * 4}</div><div>Copyright 2020 Site Inc</div></body>', "Copyright"),
    (f'<body><article><h1>Title here</h1>{P * 2}<div class="adslot"><p>Buy one lamp now</p></div>{P * 2}<div class="newsltr"><p>Our letter every week.</p><button>Join</button></div></article></body>', "Buy letter Join"),
])
def test_probed_layouts(source, gone):
    text = html_extract.extract_text(source, html_extract.trained())
    assert text.startswith("Title here Copper") and text.count("harbour") == 4
    assert not any(w in text for w in gone.split())
