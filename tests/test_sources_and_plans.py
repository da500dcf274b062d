import gzip
import io
import os
import sys
import tarfile
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from parchment.constants import PRESERVED_TERMS
from parchment.operators.answers import Answers
from parchment.plans import guide, translate
from parchment.rules.document import finish_sources
from parchment.sources import archives, lists, metadata, tree
from parchment.storage import new_path
from parchment.streaming import landing

# workers do not import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])
TEX = b"\\documentclass{a}\\begin{document}x\\end{document}"


def tar(members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members:
            if data is None:
                info = tarfile.TarInfo(name)
                info.type, info.linkname = tarfile.SYMTYPE, "x"
                t.addfile(info)
            else:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


CONTENTS = {
    "tar": tar([("./main.tex", TEX), ("fig/a.pdf", b"%PDF"), ("link", None)]), "bz2": tar([("A.TEX", TEX)], "w:bz2"), "zip": zipped([("d/", b""), ("d/m.ltx", TEX)]),
    "gz": gzip.compress(TEX), "gztar": gzip.compress(gzip.compress(TEX)), "raw": TEX, "pdf": b"%PDF-1.4", "unsafe": tar([("../x.tex", TEX)]), "words": b"plain words", "none": tar([("a.txt", b"x")]),
    "cut": gzip.compress(TEX)[:-9], "empty": b"", "null": None,
}
STATUS = {"tar": "ok", "bz2": "ok", "zip": "ok", "gz": "ok", "gztar": "no tex", "raw": "ok", "pdf": "pdf", "unsafe": "unsafe", "words": "no tex", "none": "no tex", "cut": "damaged", "empty": "no tex", "null": "no tex"}


def test_archives(spark):
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in CONTENTS.items()], "paper_id string, content binary")
    got = archives.expand(df).collect()
    assert {r["paper_id"]: r["status"] for r in got} == STATUS
    assert sorted((r["paper_id"], r["path"]) for r in got if r["path"]) == [("bz2", "A.TEX"), ("gz", "main.tex"), ("raw", "main.tex"), ("tar", "fig/a.pdf"), ("tar", "main.tex"), ("zip", "d/m.ltx")]
    flags = {r["paper_id"]: (r["g"], r["t"]) for r in df.select("paper_id", archives.looks_gzip(F.col("content")).alias("g"), archives.looks_like_tex(F.col("content")).alias("t")).collect()}
    assert flags["gz"] == (True, False) and flags["raw"] == (False, True) and flags["words"] == (False, False)


def test_tree(spark, tmp_path):
    root = tmp_path / "src tree"
    for path, data in {"p1/a.tex": TEX, "p1/a/b.TEX": b"caf\xe9\r\nx", "p1/c.sty": b"y", "p1/d.png": b"z", "p 2/n+1.ltx": b"q", "p3/only.sty": b"s"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    files = tree.with_text(tree.read_tree(spark, str(root)))
    got = [(r["paper_id"], r["path"], r["text"]) for r in files.orderBy("paper_id", "parts").collect()]
    assert got == [("p 2", "n+1.ltx", "q"), ("p1", "a/b.TEX", "caf\nx"), ("p1", "a.tex", TEX.decode()), ("p1", "c.sty", "y"), ("p3", "only.sty", "s")]
    assert sorted(r["paper_id"] for r in tree.papers_with_documents(files).collect()) == ["p 2", "p1"]
    out = str(tmp_path / "out")
    tree.write_texts(files.select("paper_id", "path", "text"), out)
    assert spark.read.parquet(out).count() == 5


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><title>A
 title</title><summary> s </summary><published>2024-01-02T00:00:00Z</published><author><name>A</name></author><author><name/></author><category term="cs.AI"/>{}</entry></feed>"""


def test_metadata_and_record(spark):
    df = spark.createDataFrame([("1", ATOM.format(""), "@misc{k, x}"), ("2", ATOM.format("<arxiv:comment>c\nd</arxiv:comment>"), "none"), ("3", "<feed xmlns='http://www.w3.org/2005/Atom'/>", "@a{b,}")], "paper_id string, body string, bibtex string")
    got = {r["paper_id"]: r for r in metadata.format_record(metadata.parse_metadata(df).withColumn("attachments", F.array(F.lit("file:///x.pdf")))).collect()}
    assert [got[k]["status"] for k in "123"] == ["ok", "no key", "no entry"]
    assert got["1"]["record"].split("\n") == ["%0 Electronic Article", "%F k", "%A A", "%T A title", "%D 2024", "%8 2024-01-02", "%J arXiv", "%U https://arxiv.org/abs/1", "%M arXiv:1", "%X s", "%K cs.AI", "%> file:///x.pdf", "", ""]
    assert "%Z c d" in got["2"]["record"] and "%T \n" in got["3"]["record"] and got["3"]["doi"] is None
    at = new_path(spark, "records")
    metadata.write_records(metadata.format_record(metadata.parse_metadata(df.filter("paper_id = '1'")).withColumn("attachments", F.lit(None).cast("array<string>"))).coalesce(1), at)
    assert spark.read.text(at, wholetext=True).first()["value"].lstrip("\ufeff").startswith("%0 Electronic Article\n%F k")


def test_term_lists(spark, tmp_path):
    (tmp_path / "pairs.md").write_text("# T\n\n| English term | Chinese |\n| --- | --- |\n| a b | 甲 |\n| A B | 乙 |\n| c | |\n| d | 丁 | note |\n", encoding="utf-8")
    (tmp_path / "terms.md").write_text("text\n- `KV cache` (kept)\n- plain\n  - Plain\n- \n", encoding="utf-8")
    pairs = lists.preferred_translations(lists.read_lines(spark, str(tmp_path / "pairs.md")))
    terms = lists.preserved_terms(lists.read_lines(spark, str(tmp_path / "terms.md")))
    assert lists.terms_or_default(terms, pairs) == (("KV cache", "plain"), (("a b", "甲"), ("d", "丁")))
    assert lists.terms_or_default(terms.limit(0), None)[0] == PRESERVED_TERMS


CONFIG = '\ufeff{ // c\n"deepseek_api_key": "", /* x\n */ "deepseek_model": "m//n", "deepseek_appendix_model": "s", "deepseek_base_url": "http://h/", "use_proxy": false, }'


def test_config(spark, tmp_path):
    assert lists.parse_config(CONFIG) == lists.Config("", "m//n", "s", "http://h/", False)
    (tmp_path / "c.jsonc").write_text(CONFIG, encoding="utf-8")
    assert lists.read_config(spark, str(tmp_path / "c.jsonc")).model == "m//n"
    for bad in ("[]", "{}", CONFIG.replace("false", '"no"'), CONFIG.replace('"m//n"', '""'), "{"):
        with pytest.raises(ValueError):
            lists.parse_config(bad)


PAPER = [
    ("p", "main.tex", "\\documentclass{article}\n\\usepackage{amsmath, b}\n% gone \\label{no}\n\\newcommand{\\own}[1]{#1}\n\\title{The  Title}\n\\begin{document}\\maketitle\n\\section{One `x`}\\label{a}\nSome prose that is long enough, with $\\sty x$ and \\own{y}.\n\\begin{table}\\end{table}\n\\appendix\\input{more}\\end{document}"),
    ("p", "more.tex", "\\subsection*{Two}\nMore words of the appendix, also many letters."), ("p", "s.sty", "\\def\\sty{z}\n\\def\\unused{q}\n\\citestyle{authoryear}"), ("q", "x.sty", "\\def\\a{}"),
]


def files(spark):
    return spark.createDataFrame(PAPER, "paper_id string, path string, text string")


def test_guide(spark):
    got = {r["paper_id"]: r["guide"] for r in guide.guides(files(spark)).collect()}
    assert set(got) == {"p"}
    g = got["p"]
    for part in ("- `section`: `One \\`x\\``\n- `subsection`: `Two`", "- Original title: `The Title`", "`amsmath`, `b`", "`document`, `table`", "There are tables", "(1 labels)", "- `\\newcommand{\\own}[1]{#1}`\n- `\\def\\sty{z}`", "- `main.tex`\n- `more.tex`", "| representation |", "- `Transformer`"):
        assert part in g, part
    assert "unused" not in g and "There are figures" not in g
    m = spark.createDataFrame([("p", "Meta", "about", "cs.AI", ["cs.AI", "cs.CL"])], "paper_id string, title string, abstract string, primary_category string, categories array<string>")
    g = guide.guides(files(spark), m).first()["guide"]
    assert "- arXiv categories: `cs.AI`, `cs.CL`" in g and "- Abstract: about" in g and "- Original title: `Meta`" in g


class Moody:
    """Fails, then breaks rules, then answers: by what the request says."""

    model = "moody"

    def __call__(self, request, fragment, route):
        if "never" in fragment:
            raise translate.TranslationError("HTTP 401", 401, False)
        if "busy" in fragment:
            raise translate.TranslationError("HTTP 503", 503, True)
        if "lost" in fragment and "rejected" not in request:
            return fragment.replace("\\emph", "\\alpha")
        if "stubborn" in fragment:
            return fragment
        return "中文 " + route + " " + "".join(x for x in ("\\emph{x}",) if "lost" in fragment)


PROSE = " these are many more than twelve plain English words that every single reader should understand without help"


def test_rounds(spark):
    chunks = ["never", "busy", "\\emph{x} lost", "stubborn" + PROSE, "fine"]
    items = spark.createDataFrame([(f"k{i}", c, "", "", "", "main") for i, c in enumerate(chunks)], "key string, chunk string, ctx_before string, ctx_after string, guide string, route string")
    got = {r["key"]: r for r in translate.translate_items(items, Moody(), wait=False).collect()}
    assert [got[f"k{i}"]["status"] for i in range(5)] == ["failed", "failed", "ok", "ok", "ok"]
    assert got["k0"]["warning"] == "HTTP 401" and got["k3"]["output"].startswith("stubborn") and "untranslated-English" in got["k3"]["warning"] and got["k2"]["output"] == "中文 main \\emph{x}"


def test_delay(spark):
    df = spark.createDataFrame([(429, 1), (429, 6), (429, 10), (500, 1), (500, 5), (500, 9)], "s int, n int").coalesce(1)
    assert [r[0] for r in df.select(translate.delay(F.col("s"), F.col("n"))).collect()] == [5, 30, 30, 2, 10, 10]


def test_whole_papers_and_cache(spark):
    cache = new_path(spark, "answers")
    t = translate.DictionaryTranslator((("prose", "文"), ("letters", "字")))
    done, messages = translate.translate_papers(files(spark), guide.guides(files(spark)), t, cache, wait=False)
    got = {r["path"]: r["text"] for r in done.collect()}
    assert len(got) == 4 and "Some 文 that" in got["main.tex"] and "% gone" not in got["main.tex"] and got["s.sty"] == PAPER[2][2]
    n = Answers(spark, cache).all().count()
    again, _ = translate.translate_papers(files(spark), guide.guides(files(spark)), t, cache, wait=False)
    assert {r["path"]: r["text"] for r in again.collect()} == got and Answers(spark, cache).all().count() == n == 2
    assert {r["paper_id"] for r in messages.collect()} <= {"p"}
    mains = spark.createDataFrame([("p", "main.tex", PAPER[0][2])], "paper_id string, path string, original string")
    papers = spark.createDataFrame([("p", "The Title")], "paper_id string, title string")
    end = {r["path"]: r["text"] for r in finish_sources(done, mains, papers, merge=True, superscript=True).collect()}
    assert "pdftitle={The Title [arXiv:p]}" in end["main.tex"] and "{ctex}" in end["main.tex"] and "不可用" in end["main.tex"] and end["s.sty"].endswith("\\citestyle{numeric}") and set(end) == set(got)


def test_landing(spark, tmp_path):
    folder = tmp_path / "land"
    folder.mkdir()
    (folder / "2401.00001.tar.gz").write_bytes(CONTENTS["tar"])
    (folder / "b.pdf").write_bytes(b"%PDF")
    out = str(tmp_path / "out")

    def run():
        stream = landing.landed_archives(spark, str(folder))
        landing.process(stream, lambda f: f.filter("path like '%.tex'").select("paper_id", "landed", "path", "text"), out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r["paper_id"], r["path"], r["text"]) for r in landing.latest(spark.read.parquet(out)).collect())

    assert run() == [("2401.00001", "main.tex", TEX.decode())]
    # a corrected archive takes the place of the first
    again = folder / "2401.00001.tex"
    again.write_bytes(b"\\documentclass{article} corrected")
    os.utime(again, (2_000_000_000, 2_000_000_000))
    assert run() == [("2401.00001", "main.tex", "\\documentclass{article} corrected")]
