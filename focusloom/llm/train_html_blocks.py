"""Trains the block labeller on made-up pages: ``python -m focusloom.llm.train_html_blocks``.

Pages vary in their frames (tags, class names, order, unclosed tags), in
languages' sentence shapes, and in what stands around the article: menus,
notices, adverts, forms, sidebars, comments, footers.
"""

from __future__ import annotations

import os
import random

import numpy as np

from focusloom.llm.html_blocks import HIDDEN, INPUT, Labeller, features, lstm, parse

MARK = "␂"  # starts every block that is main text, and is taken off again before features are made

MENU = "Home About Contact News Products Services Login Register Search Blog Help Archive Sports World Politics Shop Cart Careers Support".split()
NOTICES = ("We use cookies to improve your experience. Accept all", "This site uses cookies. Read our privacy policy.", "Subscribe to our newsletter", "Sign up for free updates", "You are using an outdated browser", "Please enable JavaScript to continue")
ADVERTS = ("Advertisement", "Sponsored content", "Buy now and save 50%", "Limited time offer", "Download our app today", "Shop the sale")
FOOTS = ("© 2024 All rights reserved", "Terms of use | Privacy policy | Contact", "Powered by software", "Copyright 2023 the publisher. All rights reserved.")
RELATED = ("Related articles", "You may also like", "Most read", "Popular posts", "Share this", "Tags:", "Follow us on social media")
FORMS = ("Your name", "Email address", "Leave a reply", "Post comment", "Your message", "Search this site", "Send")


def words(r: random.Random, n: int) -> str:
    parts = r.sample("an er th on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ße ü é è ción ado que ment eau lich keit ung ber".split(), 24)
    out = []
    for _ in range(n):
        w = "".join(r.choice(parts) for _ in range(r.choice((1, 1, 2, 2, 3, 3, 4))))
        out.append(w + r.choice(("", "", "", "", "", "", ",", ".")) if r.random() < 0.9 else w.upper())
    return " ".join(out).capitalize() + r.choice((".", ".", ".", "", "!", "?"))


def page(r: random.Random) -> str:
    style = r.random()
    c = lambda *names: f' class="{r.choice(names)}"' if r.random() < 0.7 else (f' id="{r.choice(names)}"' if r.random() < 0.5 else "")
    text = lambda a, b: words(r, r.randint(a, b))
    short = lambda: r.choice((text(1, 4).rstrip("."), text(1, 2).rstrip("."), r.choice(MENU)))

    def menu() -> str:
        items = [f'<a href="/{i}">{short()}</a>' for i in range(r.randint(2, 9))]
        kind = r.random()
        if kind < 0.6:
            inner = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        elif kind < 0.8:
            inner = " | ".join(items)
        else:
            inner = "".join(f"<div>{i}</div>" for i in items)
        tag = r.choice(("nav", "nav", "div", "header"))
        return f"<{tag}{c('menu', 'nav', 'navbar', 'main-menu', 'navigation') if tag == 'div' else ''}>{inner}</{tag}>"

    def aside() -> str:
        k = r.random()
        body = r.choice((text(3, 30), r.choice(ADVERTS), r.choice(NOTICES), r.choice(RELATED)))
        if k < 0.35:
            return f'<div class="{r.choice(("ad", "ads", "advert", "banner", "promo", "sponsored"))}">{body}</div>'
        if k < 0.5:
            return f'<div class="{r.choice(("cookie", "cookie-notice", "notice", "popup", "newsletter"))}"><p>{r.choice((body, r.choice(NOTICES)))}</p></div>'
        if k < 0.75:
            tag = r.choice(("aside", "div"))
            items = "".join(f'<li><a href="#">{text(3, 9)}</a></li>' for _ in range(r.randint(2, 6)))
            extra = f"<p>{text(5, 40)}</p>" if r.random() < 0.5 else ""
            return f"<{tag} class=\"{r.choice(('sidebar', 'related', 'widget', 'side'))}\"><h3>{r.choice((r.choice(RELATED), text(1, 3)))}</h3><ul>{items}</ul>{extra}</{tag}>"
        if k < 0.9:
            return f"<form><label>{r.choice(FORMS)}</label><input name=q><p>{r.choice((r.choice(FORMS), text(2, 8)))}</p><button>{r.choice(FORMS)}</button></form>"
        return f"<header{c('header', 'top', 'masthead')}><p>{text(1, 8)}</p></header>"

    def comments() -> str:
        if r.random() < 0.35:  # bare ones
            inner = "".join(f"<p>{text(3, 40)}</p>" for _ in range(r.randint(1, 3)))
            return f'<{r.choice(("div", "section"))} {r.choice(("class", "id"))}="{r.choice(("comments", "comment", "discussion", "replies"))}">{inner}</div></section>'
        rows = "".join(f'<{t}{c("comment", "reply", "comment-body")}><b>{short()}</b><p>{text(4, 60)}</p></{t}>' for t in [r.choice(("li", "div"))] for _ in range(r.randint(1, 5)))
        tag = r.choice(("section", "div", "ol"))
        return f'<{tag} {r.choice(("class", "id"))}="{r.choice(("comments", "discussion", "replies", "respond", "comment-list"))}"><h2>{r.choice(("Comments", "Responses", text(1, 3)))}</h2>{rows}</{tag}>'

    def article() -> str:
        title = f"<h1>{MARK}{text(2, 14)}</h1>" if r.random() < 0.85 else ""
        body = []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 13, 25))):
            k = r.random()
            p = text(1, r.choice((2, 4, 20, 60, 150)))
            if k < 0.62:
                body.append(f"<p>{MARK}{p}" + ("</p>" if r.random() < 0.9 else ""))
            elif k < 0.72:
                body.append(f"<p><b>{MARK}{p}<br>")
            elif k < 0.78:
                body.append(f"<h{r.choice('23')}>{MARK}{text(1, 8)}</h2>")
            elif k < 0.84:
                body.append("<ul>" + "".join(f"<li>{MARK}{text(2, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.88:
                body.append(f"<blockquote><p>{MARK}{p}</p></blockquote>")
            elif k < 0.91:
                body.append("<table>" + "".join(f"<tr><td>{MARK}{text(1, 4)}</td><td>{MARK}{text(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.94:
                body.append(f"<pre>{MARK}{p}</pre>")
            elif k < 0.98:
                body.append(f"<p>{MARK}{p} <a href='#'>{text(1, 5)}</a> {text(1, 12)}</p>")
            else:
                body.append(aside())
        inner = title + "".join(body)
        if style < 0.6:
            return f"<article>{inner}</article>"
        if style < 0.75:
            return f"<main>{inner}</main>"
        if style < 0.9:
            return f"<div {r.choice(('class', 'id'))}=\"{r.choice(('content', 'article', 'post', 'entry', 'story', 'main-content', 'post-body', 'entry-content', 'article-body'))}\">{inner}</div>"
        return f"<div>{inner}</div>"

    def foot() -> str:
        body = r.choice((r.choice(FOOTS), f"&copy; {short()} &middot; {text(1, 12)}", text(2, 20)))
        return f"<footer>{body}</footer>" if r.random() < 0.75 else f'<div class="{r.choice(("footer", "foot", "bottom", "copyright"))}"><p>{body}</p></div>'

    out = [r.choice(("<!DOCTYPE html><html lang=\"en\"><head><title>x</title></head><body>", "<html><body>", "<body>"))]
    if r.random() < 0.9:
        out.append(menu())
    out += [aside() for _ in range(r.choice((0, 1, 1, 1, 2)))]
    out.append(article())
    out += [aside() for _ in range(r.choice((0, 0, 0, 1, 2)))]
    if r.random() < 0.45:
        out.append(comments())
    if r.random() < 0.2:
        out.append(menu())
    if r.random() < 0.9:
        out.append(foot())
    return "".join(out) + ("</body></html>" if r.random() < 0.9 else "")


def labelled(source: str) -> tuple[np.ndarray, np.ndarray]:
    blocks = parse(source)
    y = np.array([MARK in b.text for b in blocks], np.float32)
    for b in blocks:
        b.text = b.text.replace(MARK, "") or "-"
    return features(blocks), y


def train(pages: int = 10000, epochs: int = 8, seed: int = 12, rate: float = 4e-3) -> Labeller:
    r, g = random.Random(seed), np.random.default_rng(seed)
    data = [d for d in (labelled(page(r)) for _ in range(pages)) if len(d[1])]
    w = {}
    for d in "fb":
        w[f"w{d}"] = g.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN))
        w[f"u{d}"] = g.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        w[f"b{d}"] = np.zeros(4 * HIDDEN)
        w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
    w["v"], w["a"] = g.normal(0, 0.1, 2 * HIDDEN + INPUT), np.zeros(())
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    data.sort(key=lambda d: len(d[1]))
    batches = [data[i : i + 32] for i in range(0, len(data), 32)]
    for epoch in range(epochs):
        loss = total = wrong = 0.0
        for k in g.permutation(len(batches)):
            part = batches[k]
            sizes = np.array([len(y) for _, y in part])
            t, n = sizes.max(), len(part)
            x, back, y, mask = (np.zeros((t, n, INPUT), np.float32), np.zeros((t, n, INPUT), np.float32), np.zeros((t, n), np.float32), np.zeros((t, n), np.float32))
            place = np.zeros((t, n), int)  # where a time's block stands in the other direction
            for j, (fx, fy) in enumerate(part):
                s = sizes[j]
                x[:s, j], back[:s, j], y[:s, j], mask[:s, j] = fx, fx[::-1], fy, 1
                place[:, j] = np.concatenate([np.arange(s)[::-1], np.arange(s, t)])
            states = {"f": [], "b": []}
            hf = lstm(x, w["wf"], w["uf"], w["bf"], states["f"])
            hb = lstm(back, w["wb"], w["ub"], w["bb"], states["b"])
            col = np.arange(n)[None, :]
            both = np.concatenate([hf, hb[place, col], x], axis=2)
            p = 1 / (1 + np.exp(-(both @ w["v"] + w["a"])))
            d = (p - y) * mask / mask.sum()
            loss += float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum())
            total += mask.sum()
            wrong += float((((p >= 0.5) != y) * mask).sum())
            grad = {"v": np.einsum("tn,tnd->d", d, both) + 1e-5 * w["v"], "a": d.sum()}
            dh = {"f": d[..., None] * w["v"][:HIDDEN], "b": (d[..., None] * w["v"][HIDDEN : 2 * HIDDEN])[place, col]}
            for side, source in (("f", x), ("b", back)):
                u = w[f"u{side}"]
                dz_all = np.zeros((t, n, 4 * HIDDEN), np.float32)
                du = np.zeros_like(u)
                dh_next, dc_next = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
                for q in range(t - 1, -1, -1):
                    h0, c0, i, f, o, gg = states[side][q]
                    c = f * c0 + i * gg
                    th = np.tanh(c)
                    dhq = dh[side][q] + dh_next
                    dc = dc_next + dhq * o * (1 - th * th)
                    dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dhq * th * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                    dz_all[q] = dz
                    du += h0.T @ dz
                    dh_next, dc_next = dz @ u.T, dc * f
                grad[f"w{side}"] = np.einsum("tnd,tnk->dk", source, dz_all, optimize=True)
                grad[f"u{side}"], grad[f"b{side}"] = du, dz_all.sum((0, 1))
            step += 1
            norm = sum(float((v * v).sum()) for v in grad.values()) ** 0.5
            for name, v in grad.items():
                v = np.asarray(v * min(1.0, 1.0 / (norm + 1e-9)), np.float32)
                m1[name] = 0.9 * m1[name] + 0.1 * v
                m2[name] = 0.999 * m2[name] + 0.001 * v * v
                w[name] = w[name] - rate * (0.5 ** (epoch / 2)) * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {loss / total:.4f}, wrong {wrong / total:.4f}", flush=True)
    return Labeller(w)


if __name__ == "__main__":
    model = train()
    np.savez_compressed(os.path.join(os.path.dirname(__file__), "html_blocks.npz"), **{k: v.astype(np.float16) for k, v in model.w.items()})
    r = random.Random(99)
    held = [labelled(page(r)) for _ in range(500)]
    got = model.chances([x for x, _ in held])
    print("held out: wrong", np.mean(np.concatenate([(p >= 0.5) != y for p, (_, y) in zip(got, held)])))
