"""The labelled table of the block classifier: small pages with every block marked.

``{+12}`` stands for a block of 12 words that belongs to the article, ``{-3}`` for
one of 3 words that does not.
"""

from __future__ import annotations

import random
import re

# Page layouts with labelled blocks.
LAYOUTS = (
    '<nav><ul><li><a>{-1}</a></li><li><a>{-1}</a></li><li><a>{-2}</a></li></ul></nav><div class="ad">{-9}</div>'
    '<article><h1>{+7}</h1><p><b>{+30}</b></p><p>{+2}</p><p>{+55}</p><p>{+120}</p><p>{+1}</p></article>'
    '<footer>{-11}</footer>',
    '<nav><a>{-1}</a></nav><div class="ad">{-3}</div><article><h1>{+4}</h1><p>{+18}</p><p>{+64}</p></article>'
    '<footer>{-6}</footer>',
    '<header><div class="logo"><a>{-2}</a></div><p>{-6}</p></header><div id="menu"><a>{-3}</a></div><main><h1>{+6}</h1>'
    '<p>{+44}</p><h2>{+3}</h2><p>{+80}</p><ul><li>{+8}</li><li>{+5}</li></ul><blockquote>{+21}</blockquote></main>'
    '<aside><h3>{-2}</h3><p>{-25}</p></aside><footer><p>{-14}</p><p><a>{-2}</a></p></footer>',
    '<div class="cookie-notice"><p>{-22}</p><p><a>{-1}</a></p></div><article><header><h1>{+9}</h1></header><p>{+33}</p>'
    '<p>{+5}</p><div class="advert">{-12}</div><p>{+41}</p><footer>{-8}</footer></article>'
    '<section class="comments"><h2>{-2}</h2><div class="comment"><p>{-35}</p></div><div class="comment"><p>{-60}</p></div>'
    '</section>',
    '<article><h1>{+5}</h1><p>{+70}</p><aside>{-30}</aside><p>{+12}</p><form><label>{-4}</label><p>{-7}</p></form>'
    '<section id="comments"><p>{-28}</p><p>{-90}</p></section></article>',
    '<article><h1>{+8}</h1><p>{+16}</p><p>{+24}</p></article><div class="sidebar"><h3>{-2}</h3><ul><li><a>{-5}</a></li>'
    '<li><a>{-6}</a></li></ul><p>{-40}</p></div><div class="newsletter"><p>{-15}</p></div><footer>{-9}</footer>',
    '<div class="page"><ul class="topmenu"><li><a>{-1}</a></li><li><a>{-2}</a></li><li><a>{-1}</a></li></ul>'
    '<div class="body"><h1>{+6}</h1><p>{+48}</p><p>{+95}</p><p>{+30}</p></div><p><a>{-3}</a></p><p><a>{-4}</a></p></div>',
    '<table><tr><td><a>{-1}</a></td><td><a>{-2}</a></td></tr></table><div><h2>{+5}</h2><p>{+52}</p><p>{+38}</p><p>{+4}</p>'
    '<p>{+77}</p></div><div><a>{-2}</a></div><div>{-5}</div>',
    '<div class="notice">{-16}</div><nav>{-4}</nav><main><article><h1>{+3}</h1><p>{+10}</p><p>{+140}</p><pre>{+26}</pre>'
    '<table><tr><td>{+3}</td><td>{+2}</td></tr></table><p>{+19}</p><div class="share"><a>{-1}</a></div></article>'
    '<div class="related"><a>{-8}</a></div></main><div role="contentinfo">{-10}</div>',
    '<article><h1>{+6}</h1><div class="byline">{-4}</div><p>{+29}</p><h2>{+2}</h2><p>{+17}</p><ol><li>{+9}</li><li>{+1}</li>'
    '</ol></article><article class="comment"><p>{-31}</p></article><article class="comment"><p>{-4}</p></article>',
    '<header><h1>{-3}</h1><nav><a>{-1}</a></nav></header><form><p>{-3}</p></form><article><p>{+3}</p><p>{+22}</p><p>{+66}</p>'
    '<p><a>{+2}</a></p></article><aside class="ad"><p>{-18}</p></aside><footer><div>{-20}</div></footer>',
    '<div id="header"><p>{-5}</p></div><div id="content"><p>{+46}</p><p>{+61}</p><p>{+37}</p></div><div id="footer"><p>{-13}'
    '</p></div><div id="disqus"><p>{-45}</p></div>',
    '<main><p>{+3}</p><p>{+1}</p></main><footer>{-5}</footer>',
    '<article><div><p>{+14}</p><div>{+33}</div></div><section><h3>{+2}</h3><p>{+58}</p></section></article>'
    '<div class="banner">{-20}</div><div class="popup"><p>{-26}</p></div>',
    '<p><a>{-2}</a></p><p>{+42}</p><p>{+51}</p><div>{+36}</div><p>{-3}</p><p><a>{-3}</a></p>',
)


def pages(variants: int = 12, seed: int = 3) -> list[str]:
    """The filled pages.  Where tags name the article, the word counts tell nothing, so each
    such page is repeated with drawn counts; the others are repeated with nearby counts."""
    rng = random.Random(seed)

    def fill(page: str, drawn: bool) -> str:
        named = "<article" in page or "<main" in page

        def block(m: re.Match) -> str:
            n = int(m[2])
            if drawn:
                n = round(2 ** rng.uniform(0, 9)) if named else max(1, round(n * rng.uniform(0.8, 1.5)))
            return " ".join(["KEEP" if m[1] == "+" else "DROP", *["word"] * (n - 1)])

        return f"<body>{re.sub(r'{([+-])([0-9]+)}', block, page)}</body>"

    return [fill(page, k > 0) for page in LAYOUTS for k in range(variants)]
