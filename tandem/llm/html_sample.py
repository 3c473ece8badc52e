"""Labelled pages from which the block classifier of html_text is trained.

A layout is a page with slots for text: «+a-b» is content of a to b words, «-a-b» is boilerplate; a point ends the text as a
sentence, ~ puts it into a link. ⟨...⟩a-b repeats what is inside a to b times. Filled with invented words by a seeded
generator, the layouts give any number of pages, and the label of each block is that of its slot.
"""

from __future__ import annotations

import re

import numpy as np

LAYOUTS = [
    "<body><nav><ul>⟨<li>«-1-2~»</li>⟩3-9</ul></nav><article><h1>«+3-12»</h1>⟨<p>«+8-90.»</p>⟩2-12</article><footer>«-4-20.»</footer></body>",
    "<body><header><a href=/>«-1-3»</a><form>«-1-4»<button>«-1-2»</button></form></header><main><h1>«+2-9»</h1><p>«+3-9»</p>⟨<p>«+10-70.»</p>⟩2-8<ul>⟨<li>«+3-15»</li>⟩2-6</ul><p>«+5-40.»</p></main><aside><h3>«-1-4»</h3>⟨<p>«-3-9~»</p>⟩2-6</aside></body>",
    "<body class='has-sidebar'><div id=header><div class=menu>⟨<a href=x>«-1-2»</a> ⟩3-8</div></div><div class=content><h2>«+2-9»</h2>⟨<p>«+10-80.»</p>⟩2-9<div class=share>«-2-5»</div></div><div class=sidebar>⟨<p>«-6-30.»</p>⟩1-3</div><div id=footer>«-5-25.»</div></body>",
    "<body><div class=a1>⟨<div>«-1-3~»</div>⟩4-9</div><div class=a2><h1>«+3-10»</h1>⟨<p>«+12-90.»</p>⟩3-9</div><div class=a3>«-2-6» «-1-3~»</div></body>",
    "<body><article><header><h1>«+3-10»</h1><p>«+3-8»</p></header>⟨<p>«+10-60.»</p>⟩2-7<figure><figcaption>«+3-15.»</figcaption></figure><div class=related><h4>«-1-3»</h4>⟨<a href=x>«-3-9»</a> ⟩2-5</div>⟨<p>«+6-40.»</p>⟩1-4</article><section id=comments><h3>«-1-3»</h3>⟨<article class=comment><p>«-3-60.»</p></article>⟩1-6</section></body>",
    "<body><div class=cookie-notice><p>«-8-40.»</p><button>«-1-2»</button></div><main class=page><h1>«+2-8»</h1>⟨<h2>«+1-6»</h2><p>«+5-70.»</p>⟩2-5<blockquote>«+6-40.»</blockquote><pre>«+4-30»</pre></main><footer><ul>⟨<li>«-1-3~»</li>⟩3-9</ul><p>«-4-12.»</p></footer></body>",
    "<body><article><h1>«+3-10»</h1>⟨<p>«+6-50.»</p>⟩1-4<div class=ad>«-4-15.»</div>⟨<p>«+6-50.»</p>⟩1-4<div class=x7>⟨<a href=x>«-2-8»</a><br>⟩2-6</div><div class=newsletter><p>«-5-20.»</p></div></article></body>",
    "<body><table><tr><td>⟨<a href=x>«-1-3»</a><br>⟩3-8</td><td><h1>«+2-8»</h1>⟨<p>«+8-70.»</p>⟩2-8</td></tr><tr><td>«-3-9»</td></tr></table></body>",
    "<body><div class=post><h1>«+2-8»</h1><div class=meta>«-1-4»</div>⟨<p>«+1-60.»</p>⟩3-9<ul class=tags>⟨<li>«-1-1~»</li>⟩2-5</ul></div><div class=comments>⟨<div class=x><p>«-3-50.»</p></div>⟩1-6</div></body>",
    "<body><div class=wrap><div class=banner><p>«-4-25.»</p></div><div class=b2><h1>«+2-9»</h1>⟨<p>«+2-50.» <a href=x>«+1-3»</a></p>⟩3-8<table>⟨<tr><td>«+1-4»</td><td>«+1-6»</td></tr>⟩1-4</table></div><div class=pagination>«-1-1~» «-1-1~»</div></div></body>",
    "<body><article><h1>«+3-9»</h1>⟨<p>«+1-25.»</p>⟩3-9<aside><p>«-4-30.»</p></aside><ol>⟨<li>«+4-25.»</li>⟩2-5</ol><form><p>«-3-15.»</p></form></article><div class=promo><p>«-4-20.»</p></div></body>",
    "<body><div role=navigation>⟨«-1-2~» ⟩2-7</div><div role=main>⟨<h3>«+1-7»</h3><div>«+9-60.»</div>⟩2-5<dl>⟨<dt>«+1-3»</dt><dd>«+3-20.»</dd>⟩1-4</dl></div><div role=complementary>«-4-30.»</div></body>",
    "<body><article>⟨<p>«-1-3~»</p>⟩1-3<h1>«+3-9»</h1>⟨<p>«+12-70.»</p>⟩2-6<p>«-2-5~»</p><h4>«-1-3»</h4><ul>⟨<li>«-3-8~»</li>⟩3-6</ul></article></body>",
    "<body><div class=main-content><div class=entry><p>«+1-4»</p>⟨<p>«+10-60.»</p>⟩1-6<p>«+1-5»</p></div><div class=author-box><p>«+3-20.»</p></div></div><div class=subscribe><p>«-3-15.»</p></div></body>",
]
SLOT, REPEAT = re.compile("«([+-])(\\d+)-(\\d+)([.~]?)»"), re.compile("⟨([^⟨⟩]*)⟩(\\d+)-(\\d+)")


def labelled_pages(n: int, seed: int) -> list[tuple[str, set[str]]]:
    """n pages, each with the set of its texts that are content; layouts take turns."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("etaoinshrdlucmfwypvbgk"))

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(letters, k)) for k in rng.integers(2, 10, rng.integers(a, b + 1)))

    out = []
    for i in range(n):
        page, kept = LAYOUTS[i % len(LAYOUTS)], set()
        page = REPEAT.sub(lambda m: m[1] * int(rng.integers(int(m[2]), int(m[3]) + 1)), page)

        def fill(m: re.Match) -> str:
            text = words(int(m[2]), int(m[3])).capitalize() + "." * (m[4] == ".")
            if m[1] == "+":
                kept.update(text.split())  # noqa: B023
            return f"<a href=/x>{text}</a>" if m[4] == "~" else text

        out.append((SLOT.sub(fill, page), kept))
    return out
