"""Whole pages made with a known main text: marked and unmarked, wrapped, in six languages."""

from __future__ import annotations

import random

import pytest

from tallyfold.llm.html_text import main_text

SENTENCES = {
    "en": "It was the best of times and it was the worst of times for all of the people in the town. | They had been there for a long time, and this is what they said to us about the house. | We are not sure that it will be so, but there is no other way to do it.",
    "de": "Es war die beste Zeit und es war die schlimmste Zeit für alle Leute in der kleinen Stadt. | Wir sind nicht sicher, ob das so ist, aber es gibt auch keinen anderen Weg zu dem Haus. | Der Mann ging mit dem Hund durch die Stadt, und sie sahen ihn nicht.",
    "fr": "Il est dans la maison avec les enfants et ils ne sont pas sur la route de la ville. | Nous avons vu que le roi et la reine sont dans le jardin avec tous les gens du pays. | Elle ne sait pas où il est, mais on lui a dit que ce sera pour un autre jour.",
    "es": "No es lo más importante para los que viven en la ciudad, pero sí para todos los de su casa. | El hombre y la mujer fueron a la plaza con sus hijos porque era un día muy bueno. | Ya no se sabe si este es el camino de la casa o si hay otro más corto.",
    "it": "Il governo ha deciso di aumentare le tasse per il prossimo anno in tutte le regioni. | Molti cittadini si sono detti contrari alla decisione presa durante la notte nel palazzo. | Nessuno sapeva dove fosse finita la vecchia automobile rossa del sindaco.",
    "ja": "今日は天気がとても良いので、公園へ散歩に行きました。そこで友達に会って、一緒に昼ご飯を食べました。 | 昨日の夜から雨が降り続いていて、川の水がとても多くなっていると聞きました。心配です。 | 来年の春には新しい駅ができるので、町の人たちはみんなとても楽しみにしています。",
}
WRAPS = {
    "plain": "{}",
    "article": "<article>{}</article>",
    "main": "<div class='sidebar-layout'><main>{}</main></div>",
    "form": "<form id=aspnetForm action=/>{}</form>",
    "header": "<header><div>{}</div></header>",
    "widget": "<div class='widget'>{}</div>",
    "widget-article": "<div class='widget'><article>{}</article></div>",
    "dialog": "<div role=dialog>{}</div>",
}
COMMENT = "I think that this is a great post, and I would like to say that you are right about all of it, as I have said it to all of my friends in the other town as well."
AROUND = {
    "nav": "<nav><ul><li><a href=/>Home</a><li><a href=/b>About us and our work</a></ul></nav>",
    "footer": "<footer><p>© 2024 The company of the town. All rights reserved by us and by the others who made it.</p></footer>",
    "cookies": "<div class='cookie-banner'><p>We use cookies on this site so that you have the best of it.</p></div>",
    "links": "<ul>" + "".join(f"<li><a href=/{i}>Another story of the day {i}</a></li>" for i in range(6)) + "</ul>",
    "comments": f"<div id=comments><h3>Comments</h3><article class=comment-body><p>{COMMENT}</p></article><article class=comment-body><p>{COMMENT}</p></article></div>",
    "list": f"<ol class=comment-list><li class=comment><p>{COMMENT}</p></li></ol>",
    "script": "<script>var a = '<p>not text</p>';</script><style>p { color: red }</style>",
}


def paragraphs(r: random.Random, lang: str, n: int) -> list[str]:
    sentences = [s.strip() for s in SENTENCES[lang].split("|")]
    return [" ".join(r.choices(sentences, k=r.randint(2, 5))) for _ in range(n)]


@pytest.mark.parametrize("wrap", sorted(WRAPS))
@pytest.mark.parametrize("lang", sorted(SENTENCES))
def test_main_text_of_made_pages(wrap, lang):
    """The article whole and nothing else, whatever the page states as its language."""
    r = random.Random(f"{wrap} {lang}")
    for _ in range(40):
        own = paragraphs(r, lang, r.randint(4, 8))
        around = r.sample(sorted(AROUND), r.randint(0, 5))
        cut = r.randint(0, len(around))
        before, after = ("".join(AROUND[a] for a in some) for some in (around[:cut], around[cut:]))
        stated = r.choice(["", f" lang={lang}", " lang=en", " lang=xx"])
        page = f"<!doctype html><html{stated}><head><title>t</title></head><body>{before}{WRAPS[wrap].format(''.join(f'<p>{p}</p>' for p in own))}{after}</body></html>"
        assert main_text(page) == "\n".join(own), page


def test_pages_without_marks():
    """Short paragraphs, halves in two widgets, a region that isn't lifted by a teaser inside."""
    r = random.Random(1)
    p, q = (" ".join(paragraphs(r, "en", 1)[0].split()[:20]) for _ in range(2))
    wide = " ".join(paragraphs(r, "en", 3))
    assert main_text(f"<body><p>{p}</p><p>{q}</p><p>{p}</p></body>") == f"{p}\n{q}\n{p}"
    assert main_text(f"<div class=widget><p>{wide}</p></div><div class=widget><p>{wide}</p></div>") == f"{wide}\n{wide}"
    assert main_text(f"<article><p>{wide}</p><section class=related-posts><article><p>{p}</p></article></section></article>") == wide
    assert main_text(f"<main><p>{wide}</p></main><section class=related><article><p>{p}</p></article></section>") == wide
    assert main_text(f"<div class=comments><article class=comment><p>{COMMENT}</p></article></div>") == ""
    assert main_text(f"<article><p>{wide}</p><article class=comment><p>{COMMENT}</p></article></article>") == wide
    assert main_text(f"<article class='post comments-open'><p>{wide}</p></article>") == wide


def test_pages_of_nothing():
    assert main_text("<nav><a href=/>Home</a></nav><ul><li><a href=/>One</a></li></ul><p>Hi</p>") == ""
    assert main_text(f"<div hidden><p>{COMMENT}</p></div><div aria-hidden=true>{COMMENT}</div>") == ""
