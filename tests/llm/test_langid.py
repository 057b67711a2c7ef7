import html
import math
import random
import re
import time
from collections import Counter

from psephos.llm import langid


def test_one_pass_as_the_patterns():
    """The patterns say what is meant; one pass gives the same."""
    hidden = re.compile(r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    said = re.compile(r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,8})""")
    bits = ["<", ">", "<script>", "</script >", "<Style a=1>", "</STYLE>", "<template", "</template>", "<!--", "-->", "<!-->", "a", " b ", "<p>", "</p>", "&amp;", "&#65;", "<html", " lang=", " lang = 'fr'", "de>", "\n", "<scripts>", "--"]
    rnd = random.Random(2)
    for _ in range(20_000):
        page = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert langid.visible(page) == html.unescape(hidden.sub(" ", page)), page
        m = said.search(page)
        assert langid.declared(page) == (m[1].lower() if m else None), page


def test_hostile_pages_take_no_longer():
    for bit in ("<", "<script>", "<!--", "<!-- >", "<style>", "<html ", "<html lang", "&#", "&", "<script>x</scrip", "<template></template ", "</script", "< lang="):
        page = bit * (5_000_000 // len(bit))
        began = time.process_time()
        for p in (page, page + ">", page + "-->"):
            langid.visible(p), langid.declared(p)
        assert time.process_time() - began < 25, bit
    assert langid.unescaped("&#" + "1" * 10_000 + ";x") == "\ufffdx" and langid.unescaped("&#" + "0" * 9000 + "65;") == "A" and langid.unescaped("&#0000000065x") == "Ax"


def test_visible():
    assert langid.visible("<p>a<b>b</b></p><script>x<y</script><!-- c --> &amp;").split() == ["a", "b", "&"]
    assert langid.visible(None) == ""


DOCS = [("en", "the house and the garden of the king"), ("en", "this is what they have"), ("de", "das haus und der garten des königs"), ("de", "sie haben nicht gewußt"), ("fr", "la maison et le jardin du roi"), (None, "zzz"), ("fr", None)]


def test_evidence_is_fused(spark):
    docs = spark.createDataFrame(DOCS, "lang string, text string")
    page = lambda lang, text: f'<html lang="{lang}"><body>{text}</body></html>'
    rows = [(i, f"http://a.x.de/{i}", page("de", "das haus und der garten")) for i in range(30)]
    rows += [(100 + i, f"http://b.y.org/en/{i}", page("en", "the king and the house")) for i in range(30)]
    rows += [(200, "http://a.x.de/7", page("en", "")), (201, None, None), (202, "http://b.y.org/en/", page("de", "la maison et le jardin du roi et la maison du jardin")), (203, "http://a.x.de/9", None), (200, "http://a.x.de/7", page("en", ""))]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, host string")
    out = {}
    for r in langid.identify(df, docs).collect():
        out.setdefault(r.page_id, r)
    assert langid.identify(df, docs).count() == len(rows)
    assert all(out[i].lang == "de" for i in range(30)) and all(out[100 + i].lang == "en" for i in range(30))
    assert out[202].lang == "fr" and out[203].lang == "de" and out[203].text_lang is None
    assert all(0 < r.probability <= 1 + 1e-12 for r in out.values()) and out[201].lang is not None
    assert langid.identify(df.where("false"), docs).count() == 0
    assert {r.lang for r in langid.identify(df, docs.where("false")).collect()} == {None}


def test_accuracy(spark, sf):
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    rows = langid.identify(pages, docs).collect()
    assert len(rows) == pages.count()
    assert sum(r.lang == r.declared for r in rows) >= 0.97 * len(rows) and sum(r.text_lang == r.declared for r in rows) >= 0.9 * len(rows)


def plain_identify(pages, docs, tempering=0.3, weight=4.0, alpha=1.0):
    """The same by loops over dictionaries: (language, probability) of each page."""
    def grams(text):
        b = [32, *[32 if x < 65 and x != 39 else x for x in text.encode().lower()], 32]
        return [(int.from_bytes(bytes(b[i : i + 3]), "big") * 0x9E3779B97F4A7C15 % 2**64) >> 50 for i in range(len(b) - 2) if b[i] != 32 or b[i + 1] != 32]

    langs = sorted({lang for lang, _ in docs if lang})
    counts = {x: Counter(g for lang, t in docs if lang == x for g in grams(t or "")) for x in langs}
    total = {x: sum(counts[x].values()) + 0.5 * 2**14 for x in langs}
    seen = []
    for url, page in pages:
        host = url.split("://", 1)[1].split("/")[0].lower() if url and "://" in url else ""
        path = url.split("://", 1)[1][len(host) :] if host else ""
        text = grams(langid.visible(page))
        ll = [sum(math.log((counts[x][g] + 0.5) / total[x]) for g in text) for x in langs]
        own = langs[max(range(len(langs)), key=lambda i: (ll[i], -i))] if text else None
        declared = page.split('lang="')[1].split('"')[0].lower() if page and '<html lang="' in page else None
        segment = path.split("/")[1].lower() if path.count("/") > 1 else None
        mark = segment if segment in langs else (host.split(".")[-1] if host.split(".")[-1] in langs else None)
        seen.append((host, ll, own, declared if declared in langs else None, mark))

    def believed(k, lang, value):
        of = [s[k] for s in seen if s[2] == lang]
        return math.log((of.count(value) + alpha) / (len(of) + alpha * (len(langs) + 1)))

    every = Counter(s[2] for s in seen if s[2])
    everywhere = {x: (every[x] + alpha) / (sum(every.values()) + alpha * len(langs)) for x in langs}
    part = lambda n: lambda host: ".".join(host.split(".")[-n:])

    def smoothed(level, key, prior):
        n = Counter(s[2] for s in seen if s[2] and level(s[0]) == key)
        return {x: (n[x] + weight * prior[x]) / (sum(n.values()) + weight) for x in langs}

    out = []
    for host, ll, own, said, mark in seen:
        domain = smoothed(part(2), part(2)(host), smoothed(part(1), part(1)(host), everywhere))
        n = Counter(s[2] for s in seen if s[2] and s[0] == host)
        if own:
            n[own] -= 1
        prior = {x: (n[x] + weight * domain[x]) / (sum(n.values()) + weight) for x in langs}
        p = [tempering * a + math.log(prior[x]) + believed(3, x, said) + believed(4, x, mark) for x, a in zip(langs, ll)]
        best = max(range(len(langs)), key=lambda i: (p[i], -i))
        out.append((langs[best], 1 / sum(math.exp(x - p[best]) for x in p)))
    return out


def test_against_plain_loops(spark):
    """Random pages on hosts under shared domains and suffixes, ties, pages without text or url, long ones, against loops."""
    rnd = random.Random(7)
    docs = [(lang, t) for lang, t in DOCS if lang] + [("es", "la casa y el jardín del rey"), ("en", None)]
    words = {"en": "the house garden king and what they have".split(), "de": "das haus der garten königs nicht sie".split(), "fr": "la maison le jardin du roi et".split(), "es": "la casa el jardín rey y".split()}
    pages = []
    for _ in range(150):
        lang = rnd.choice(list(words))
        text = " ".join(rnd.choice(words[lang]) for _ in range(rnd.choice([0, 1, 3, 8, 20])))
        host = rnd.choice(["a.x.de", "b.x.de", "y.de", "a.y.org", "z.org", "fr.w.fr", "q.com"])
        url = rnd.choice([f"http://{host}/{rnd.choice(['en', 'de', 'zz', 'fr'])}/1", f"http://{host}/", f"http://{host}", None, "no scheme"])
        pages.append((url, rnd.choice([f'<html lang="{rnd.choice(["en", "de", "xx", lang])}"><p>{text}</p>', f"<p>{text}", text, None])))
    pages += [pages[0], (None, None), ("http://y.de/", "das haus " * 20_000)]
    frame = spark.createDataFrame([(i, u, h, 0.5, ["x"]) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, probability double, loglik array<string>").repartition(3)
    got = {r.page_id: (r.lang, r.probability) for r in langid.identify(frame, spark.createDataFrame(docs, "lang string, text string")).collect()}
    for i, (lang, p) in enumerate(plain_identify(pages, docs)):
        assert got[i][0] == lang and abs(got[i][1] - p) < 1e-9, (i, pages[i], got[i], lang, p)
