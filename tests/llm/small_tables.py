"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq

WORDS = {
    "en": "the and of with that river stone letter under bright morning walked house quiet table window carried".split(),
    "de": "der und das nicht stein fluss brief unter hell morgen ging haus ruhig tisch fenster getragen über".split(),
    "fr": "le et la avec que rivière pierre lettre sous clair matin marchait maison calme fenêtre portée été".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + (str(rng.randrange(40)) if rng.random() < 0.1 else "") for _ in range(n))


def write(folder, name: str, rows: list[dict], schema: pa.Schema) -> None:
    pq.write_table(pa.Table.from_pylist(rows, schema), folder / f"{name}.parquet")


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("score", pa.string()), ("kept", pa.string()), ("size", pa.string()), ("tk", pa.string()), ("a", pa.string())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32()), ("y", pa.string())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("host", pa.string())])
BENCHMARK = pa.schema([("item_id", pa.int64()), ("text", pa.string()), ("item", pa.string())])


def corpus() -> dict[str, list[dict]]:
    rng = random.Random(5)
    texts: list[str | None] = [None, "", "   \n\t ", "one", "Two WORDS", "a b c d", "1234 !!! —", "\x00\x01 nul bytes \x0b here"]
    langs: list[str | None] = [None] * len(texts)
    base = [prose(rng, lang, rng.randrange(20, 160)) for lang in ("en", "de", "fr") for _ in range(25)]
    langs += [lang for lang in ("en", "de", "fr") for _ in range(25)]
    texts += base
    for i in range(8):  # near copies: one word changed
        w = base[3].split()
        w[i] = "changed"
        texts.append(" ".join(w))
        langs.append("en")
    texts += [base[5]] * 6 + [base[6] + " idiot and moron idiot", base[7] + " you clown, idiot trash"] * 8
    langs += ["en"] * 22
    passage = prose(rng, "en", 30)
    texts += [f"{prose(rng, 'en', 12)} {passage.upper()} {prose(rng, 'en', 9)}", passage, "tiny item here", passage + " " + passage]
    langs += ["en"] * 4
    boiler = "Copyright holder number {} grants the right to copy this notice"
    texts += [f"{prose(rng, 'en', 14)}\n{boiler.format(i)}\n{prose(rng, 'en', 11)}\nshort line" for i in range(7)]
    langs += ["en"] * 7
    texts += [prose(rng, "de", 30_000), "x" * 50_000, "write me at a.b@c-d.org or +1 (555) 123-4567, ip 10.0.0.255 and 4111 1111 1111 1111"]
    langs += ["de", None, "en"]
    sources = [None, "", "alpha", "beta", "beta", "beta", "é"]
    docs = [{"doc_id": i, "text": t, "lang": g, "source": sources[i % 7], "n_chars": len(t or ""), "score": "x", "kept": None, "size": "1", "tk": "z", "a": "q"} for i, (t, g) in enumerate(zip(texts, langs))]
    docs.append(docs[20] | {"n_chars": None})  # a repeated row
    docs.append(docs[21] | {"doc_id": None})
    docs.append(docs[22] | {"doc_id": docs[23]["doc_id"]})  # one identifier, two texts
    toxic = [{"doc_id": d["doc_id"], "quality": 1, "toxic": int("idiot" in (d["text"] or "")), "y": "n"} for d in docs[8:120]]
    labels = [*toxic, {"doc_id": None, "quality": 0, "toxic": 1, "y": None}, {"doc_id": 9, "quality": None, "toxic": None, "y": None}, toxic[0]]
    urls = [None, "", "no scheme", "http://", "http://a.net", "https://x.a.net/p?q#f", "HTTP://WWW.Example.NET/en/1", "http://example.net/EN/1", "http://badexample.net/en/", "ftp://u@example.com:80/de/x", "http://example.com/de/x/", "http://q.org/fr/", "http://q.org/fr", "http://cheap-pills.x.io/a",
            "http://é.org/fr/ü?x", "a://b://c.net/", "http://net/", "http://host.io#frag/x", "http://host.io?x://y.net/", "http://line\nbreak.net/a", "http://" + "a" * 3000 + ".net/x.exe"]
    pages = [{"page_id": i, "url": u, "html": "<p>", "host": "clash"} for i, u in enumerate([*urls, urls[5], urls[5]])]
    bench = [{"item_id": 10, "text": passage, "item": "c"}, {"item_id": 2, "text": passage, "item": "c"}, {"item_id": 3, "text": "Tiny item HERE", "item": "c"}, {"item_id": 4, "text": None, "item": None}, {"item_id": 5, "text": "?!", "item": None}, {"item_id": None, "text": "one", "item": None}]
    return {"documents": docs, "labels": labels, "pages": pages, "benchmark": bench}


def save(folder, tables: dict[str, list[dict]]) -> str:
    for name, schema in (("documents", DOCUMENTS), ("labels", LABELS), ("pages", PAGES), ("benchmark", BENCHMARK)):
        write(folder, name, tables[name], schema)
    return str(folder)
