"""Pages made by rule, with the texts of their content blocks known: what the classifier of ``html_extract`` is trained on."""

from __future__ import annotations

import random

#: Pages of each layout.
PAGES = 40


class Maker:
    """Texts of one page; ``content`` collects those that belong to the article."""

    def __init__(self, rng: random.Random):
        self.rng, self.content, self.n = rng, set(), 0

    def words(self, low: int, high: int) -> str:
        self.n += 1
        count = self.rng.randint(low, high)
        return " ".join([f"Text{self.n}"] + ["".join(self.rng.choice("aeioustrnlm") for _ in range(self.rng.randint(2, 8))) for _ in range(count - 1)])

    def keep(self, low: int, high: int) -> str:
        x = self.words(low, high)
        self.content.add(x)
        return x

    def prose(self) -> str:
        """Paragraphs, now and then short, a list, a heading or a paragraph that is one link."""
        out = [f"<h1>{self.keep(3, 10)}</h1>"]
        for _ in range(self.rng.randint(3, 9)):
            kind = self.rng.random()
            if kind < 0.7:
                out.append(f"<p>{self.keep(15, 90)}</p>")
            elif kind < 0.82:
                out.append(f"<p>{self.keep(1, 8)}</p>")
            elif kind < 0.9:
                out.append(f"<h2>{self.keep(2, 6)}</h2><p>{self.keep(20, 60)}</p>")
            elif kind < 0.96:
                out.append("<ul>" + "".join(f"<li>{self.keep(2, 12)}</li>" for _ in range(3)) + "</ul>")
            else:
                out.append(f"<p><a href=x>{self.keep(3, 8)}</a></p><p>{self.keep(20, 60)}</p>")
        return "".join(out)

    def links(self, low: int = 3, high: int = 9) -> str:
        return "<ul>" + "".join(f"<li><a href=x>{self.words(1, 3)}</a></li>" for _ in range(self.rng.randint(low, high))) + "</ul>"

    def teasers(self) -> str:
        return "".join(f"<h3><a href=x>{self.words(3, 8)}</a></h3><p>{self.words(8, 25)}</p>" for _ in range(self.rng.randint(1, 4)))

    def comments(self) -> str:
        return "".join(f"<div class=comment><p>{self.words(2, 40)}</p></div>" for _ in range(self.rng.randint(1, 5)))


def _blog(m: Maker) -> str:
    return f"<header><h1>{m.words(1, 4)}</h1></header><div class=ad>{m.words(3, 20)}</div><article>{m.prose()}<aside>{m.words(10, 40)}</aside></article><section id=comments>{m.comments()}</section><footer>{m.words(3, 30)}</footer>"


def _news(m: Maker) -> str:
    return f"<div class=topbar>{m.links()}</div><main><section class=story>{m.prose()}<div class='share'>{m.links(2, 4)}</div></section></main><aside class=sidebar>{m.teasers()}</aside><div class='legal'>{m.words(5, 30)}</div>"


def _classes(m: Maker) -> str:
    return f"<div id=masthead><p>{m.words(1, 5)}</p></div><div id=menu>{m.links()}</div><div class=content>{m.prose()}</div><div class='sidebar'>{m.teasers()}</div><div class=cookie-consent><p>{m.words(8, 25)}</p></div><div class=footer>{m.words(3, 20)}</div>"


def _bare(m: Maker) -> str:
    return f"<table><tr><td>{m.links()}</td><td>{m.prose()}</td></tr></table><p><a href=x>{m.words(1, 3)}</a> <a href=x>{m.words(1, 3)}</a></p><p>{m.words(2, 4)}</p>"


def _sections(m: Maker) -> str:
    return f"<div class=page><div class=entry>{m.prose()}<div class=discussion><h2>{m.keep(1, 4)}</h2><p>{m.keep(20, 60)}</p></div></div><div class=related>{m.teasers()}</div><div class=notice><p>{m.words(5, 20)}</p></div></div>"


def training_pages(seed: int = 1) -> list[tuple[str, set[str]]]:
    """(page, texts of its content blocks); the same for the same seed."""
    rng, out = random.Random(seed), []
    for layout in (_blog, _news, _classes, _bare, _sections):
        for _ in range(PAGES):
            m = Maker(rng)
            out.append((f"<html><body>{layout(m)}</body></html>", m.content))
    return out
