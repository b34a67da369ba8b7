"""Workspace logs, node trees, mail charsets and chunks on odd rows."""

import base64
import json
import random

from pyspark.sql import functions as F

from lattica.operators import chunks, workspace
from lattica.sources import adf, mail


def text(value, *marks):
    return {"type": "text", "text": value, "marks": [m if isinstance(m, dict) else {"type": m} for m in marks]}


def node(kind, *content, **attrs):
    return {"type": kind, "content": list(content), "attrs": attrs}


def para(*content):
    return node("paragraph", *content)


def render(tree):
    return adf.markdown_of(json.dumps(tree))


def test_marks_compose_from_the_inside_out():
    link = {"type": "link", "attrs": {"href": "https://x.com"}}
    sub, sup = ({"type": "subsup", "attrs": {"type": t}} for t in ("sub", "sup"))
    assert render(para(text("w", "strong", "em", link))) == "[***w***](https://x.com)"
    assert render(para(text("a", "strike"), text("b", "underline"), text("c", "code"), text("2", sub), text("3", sup), text("", "strong"))) == "~~a~~b`c`~2~^3^"
    assert render(para(text("d", {"type": "link"}), text("e", "unknown"))) == "de"


def test_blocks_lists_tables_and_panels():
    inner = node("orderedList", node("listItem", para(text("one"))), node("listItem", para(text("two")), node("codeBlock", text("x\n y"), language="sql")), order=3)
    assert render(node("bulletList", node("listItem", para(text("outer")), inner))) == "- outer\n  3. one\n  4. two\n    ```sql\n    x\n     y\n    ```"
    cell = lambda kind, *c: node(kind, *map(para, map(text, c)))
    table = node("table", node("tableRow", cell("tableHeader", "Name"), cell("tableHeader", "Age")), node("tableRow", cell("tableCell", "A|B", "more")), node("tableRow", cell("tableCell", "C"), cell("tableCell", "1\n2")))
    assert render(table) == "| Name | Age |\n| --- | --- |\n| A\\|B more |  |\n| C | 1 2 |"
    assert render(node("table")) == "" == render(node("doc")) == render({"type": "phantom"})
    assert render(node("doc", para(text("A")), para(), para(text("B")), {"type": "rule"})) == "A\n\nB\n\n---"
    assert render(node("panel", para(text("p")), para(text("q")), panelType="info")) == "> ℹ️ p\n>\n> q"
    assert render(node("panel", para(text("p")), panelType="custom")) == "> p" == render(node("blockquote", para(text("p"))))
    assert render(para(text("a"), {"type": "hardBreak"}, text("b"))) == "a  \nb" and render(node("heading", text("T"), level=3)) == "### T"
    assert render(node("codeBlock", text("plain"))) == "```\nplain\n```" and render(node("unknown", para(text("reachable")))) == "reachable"


def test_inline_nodes_and_missing_attributes():
    one = lambda kind, **attrs: render(para(node(kind, **attrs)))
    assert [one("mention", text="@Al"), one("mention", displayName="Bob"), one("mention", id="u-1"), one("mention")] == ["@Al", "@Bob", "@u-1", ""]
    assert [one("emoji", shortName=":s:", text="x"), one("emoji", text="x"), one("inlineCard", url="https://e"), one("inlineCard")] == [":s:", "x", "[https://e](https://e)", ""]
    assert render(node("mediaSingle", node("media", url="https://i.png", alt="d"))) == "![d](https://i.png)" and render(node("media", id="m-1")) == "<!-- media:m-1 -->" and render(node("media")) == ""
    assert [adf.markdown_of(t) for t in (None, "", "no json", "[1]", "3")] == [None, "", "no json", "[1]", "3"]
    assert render({"type": "paragraph", "content": None, "attrs": None}) == "" and render({"type": "text"}) == ""


def test_mail_parts_by_their_own_charset(spark):
    rows = [("iso-8859-1", "naïve"), ("windows-1252", "“quoted” – €5"), ("koi8-r", "Привет"), ("shift_jis", "日本語"), ("gb2312", "你好"), ("utf-8", "Ünï"), ("", "plain é"), ("x-unknown", "utf é")]
    data = [(c, base64.urlsafe_b64encode(t.encode(c if c and c != "x-unknown" else "utf-8")).decode(), t) for c, t in rows]
    df = spark.createDataFrame([*data, ("utf-8", base64.urlsafe_b64encode(b"a\xff").decode(), "a�"), ("koi8-r", None, "")], "charset string, data string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", mail.decoded(F.col("data"), F.col("charset"))).collect())


def test_memory_log_equals_a_fold(spark):
    rng = random.Random(21)
    rows = [(rng.randrange(12), at, rng.choice(["create", "update", "update", "delete"]), *(rng.choice([None, f"{c}{at}"]) for c in "rtbk")) for at in range(200)]
    state = {}
    for i, at, op, *values in rows:
        if op == "create" and i not in state:
            state[i] = [*values, at, at]
        elif op == "update" and i in state:
            state[i] = [new if new is not None else old for new, old in zip(values, state[i])] + [state[i][4], at]
        elif op == "delete":
            state.pop(i, None)
    rng.shuffle(rows)
    rows += [(None, 1, "create", "r", "t", "b", "k"), (99, None, "create", "r", "t", "b", "k"), (98, 5, "delete", None, None, None, None)]
    items = workspace.memory_items(spark.createDataFrame(rows, "id long, at long, op string, region_key string, title string, body string, kind string"))
    assert {r.id: [r.region_key, r.title, r.body, r.kind, r.created, r.updated] for r in items.collect()} == state and state
    keys = spark.createDataFrame([(v[0],) for v in state.values()], "region_key string")
    newest = [r.id for r in workspace.memory_of(items, keys, 3).collect()]
    assert newest == sorted((i for i in state if state[i][0]), key=lambda i: (-state[i][4], i))[:3]


def test_anchors_visits_and_briefs(spark):
    log = spark.createDataFrame([("k", 1, "orphan", None, None, None), ("k", 2, "attach", "a", "A", 1), ("k", 3, "attach", "a", "A2", 2), ("k", 4, "attach", "b", "B", 1), ("k", 5, "orphan", None, None, None), ("k", 6, "attach", "a", "A3", 1), ("k", 7, "attach", "c", "C", 0), ("m", 1, "attach", "a", "A", 1), ("m", 2, "orphan", None, None, None), ("n", 1, "orphan", None, None, None)], "key string, at long, op string, region_id string, region_name string, level int")
    state = workspace.anchors(log)
    got = {r.key: (r.region_id, r.region_name, r.level, r.status, r.history, r.created, r.updated) for r in state.collect()}
    assert got == {"k": ("c", "C", 0, "attached", ["a", "b"], 2, 7), "m": (None, "A", 1, "orphaned", ["a"], 1, 2)}
    assert {r.old_id: r.key for r in workspace.anchors_by_old_id(state).collect()} == {"a": "m", "b": "k"}
    stored = spark.createDataFrame([("x", 5), ("y", 9)], "region_key string, at long")
    touches = spark.createDataFrame([("x", 7), ("x", 8), ("x", 8), ("z", 1), ("z", None)], "region_key string, at long")
    assert {tuple(r) for r in workspace.touched(stored, touches).collect()} == {("x", 7, 5), ("x", 8, 7), ("z", 1, None)}
    schema = "region_key string, text string, terrain_generated_at string, created_at long"
    now = workspace.briefs(spark.createDataFrame([("x", "old", "g1", 1), ("y", "kept", "g1", 3)], schema), spark.createDataFrame([("x", "new", "g2", 1), ("y", "older", "g2", 2), ("z", "first", "g2", 4)], schema))
    assert {r.region_key: r.text for r in now.collect()} == {"x": "new", "y": "kept", "z": "first"}
    wanted = spark.createDataFrame([("x", "g2"), ("y", "g2"), ("w", "g2")], "region_key string, generated_at string")
    assert {r.region_key for r in workspace.stale_briefs(now, wanted).collect()} == {"y", "w"}


def plain_chunks(doc_id, body, least, most, target):
    import hashlib
    import re

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    parts, path, lines = [], [], []
    for line in (body or "").split("\n"):
        head = re.match(r"^(#{1,6})\s+(\S.*)$", line)
        if head and lines:
            parts.append((path, "\n".join(lines).strip()))
            lines = []
        if head:
            path = [*((n, t) for n, t in path if n < len(head[1])), (len(head[1]), head[2].strip())]
        lines.append(line)
    parts = [([x for _, x in p], t) for p, t in [*parts, (path, "\n".join(lines).strip())] if t]
    made = [[f"chunk_{sha(f'{doc_id}:{i}:sha256:{sha(t)}')[:20]}", p, t] for i, (p, t) in enumerate(parts)]
    out = []
    for c in made:
        if out and len(out[-1][2].split()) < least:
            out[-1] = [out[-1][0], list(dict.fromkeys([*out[-1][1], *c[1]])), out[-1][2] + "\n\n" + c[2]]
        else:
            out.append(c)
    rows = []
    for i, p, t in out:
        words = t.split()
        rows += [(i, p, t)] if len(words) <= most else [(f"{i}_{k // target + 1}", p, " ".join(words[k : k + target])) for k in range(0, len(words), target)]
    return rows


def test_chunks_equal_a_plain_walk(spark):
    rng = random.Random(22)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "https://x/1.", "@ann", "AB-12"]) for _ in range(n))
    body = lambda: "\n".join(rng.choice(["", "#" * rng.randint(1, 3) + f" Head {rng.randrange(9)}", words(rng.randrange(1, 14))]) for _ in range(40))
    rows = [(i, "T", [("1", "Top"), ("2", None), ("3", "")], body()) for i in range(12)] + [(20, "Top", [("1", "Top")], "one line"), (21, "T", None, None), (22, "T", [], "  \n "), (23, "T", [], "# Only\n\n# Next"), (24, "T", [], words(3000))]
    df = spark.createDataFrame(rows, "doc_id long, title string, ancestors array<struct<id:string,title:string>>, text string")
    got = chunks.document_chunks(df, 10, 25, 12).orderBy("doc_id", "pos", "k").collect()
    found = {}
    for r in got:
        found.setdefault(int(r.doc_id), []).append((r.id, r.path, r.content))
    want = {i: plain_chunks(i, t, 10, 25, 12) for i, _, _, t in rows}
    assert found.keys() == {i for i, w in want.items() if w}
    for i, rows in found.items():
        assert rows == want[i]
    assert {tuple(r.breadcrumbs) for r in got if r.doc_id == "0"} == {("Top", "T")} and {tuple(r.breadcrumbs) for r in got if r.doc_id == "20"} == {("Top",)}
    assert len({r.id for r in got}) == len(got) and all(r.n_words == len(r.content.split()) for r in got)


def test_the_longest_folder_names_the_scope(spark):
    from lattica.sources import files

    found = spark.createDataFrame([("v", "a/b/c.md"), ("v", "a/x.md"), ("v", "top.md"), ("v", "ab/y.md"), ("w", "a/b/c.md")], "scope string, relative string")
    scopes = spark.createDataFrame([("v", "one", "a"), ("v", "two", "/a/b/"), ("v", "two", "a/b"), ("w", "all", "")], "scope string, origin_scope_id string, folder string")
    got = {(r.scope, r.relative): r.origin_scope_id for r in files.origin_scopes(found, scopes).collect()}
    assert got == {("v", "a/b/c.md"): "two", ("v", "a/x.md"): "one", ("v", "top.md"): None, ("v", "ab/y.md"): None, ("w", "a/b/c.md"): "all"}


def test_a_chain_page_is_capped_in_its_order(spark):
    from lattica.operators import harvest

    rows = spark.createDataFrame([(i, "x" if i % 2 else None) for i in range(9)], "id int, space string")
    tied = lambda *caps: [tuple(r) for r in harvest.chain_graph(rows, ["space"], ["id"], "id", *caps).collect()]
    assert tied(6, 99) == [(0, 2), (2, 4), (1, 3), (3, 5)] and tied(6, 3) == [(0, 2), (2, 4), (1, 3)] and tied(0, 5) == []
