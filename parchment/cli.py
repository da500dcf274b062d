"""`python -m parchment.cli SOURCES OUT`: source trees in, guides, translated sources, records and reports out."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .constants import CHUNK_CHARS, CONTEXT_CHARS
from .operators.documents import main_files, without_completed
from .operators.validate import warning_report
from .plans.guide import guides
from .plans.translate import DictionaryTranslator, RemoteTranslator, translate_papers
from .rules.document import finish_sources
from .schema import STATE
from .session import session
from .sources.lists import preferred_translations, preserved_terms, read_config, read_lines, terms_or_default
from .sources.metadata import format_record, parse_metadata, write_records
from .sources.tree import read_tree, with_text, write_texts
from .storage import read_or_empty, stored


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="parchment", description=__doc__)
    p.add_argument("sources", help="a folder with a folder of sources per paper")
    p.add_argument("out", help="a new folder for the results")
    p.add_argument("--metadata", help="Parquet: paper_id, body (Atom), bibtex")
    p.add_argument("--state", help="Parquet of what is done already")
    p.add_argument("--cache", help="a folder of answers, kept between runs")
    p.add_argument("--config", help="JSON with comments: the remote model; without it, terms are replaced from the list alone")
    p.add_argument("--terms", help="Markdown list of terms that stay in English")
    p.add_argument("--translations", help="Markdown table of fixed translations")
    p.add_argument("--chunk-chars", type=int, default=CHUNK_CHARS)
    p.add_argument("--context-chars", type=int, default=CONTEXT_CHARS)
    p.add_argument("--parallel-chunks", type=int, default=8, help="requests at a time, at most")
    p.add_argument("--merge-citations", action="store_true")
    p.add_argument("--superscript-citations", action="store_true")
    p.add_argument("--no-compile", action="store_true", help="a paper with translated sources counts as done")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    try:
        config = read_config(spark, args.config) if args.config else None
    except ValueError as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 1
    terms, pairs = terms_or_default(preserved_terms(read_lines(spark, args.terms)) if args.terms else None, preferred_translations(read_lines(spark, args.translations)) if args.translations else None)
    files = with_text(read_tree(spark, args.sources))
    if args.state:
        files = without_completed(files, read_or_empty(spark, args.state, STATE), not args.no_compile)
    files = stored(files.select("paper_id", "path", "text"), "sources")
    papers = files.select("paper_id").distinct()
    if args.metadata:
        papers = papers.join(parse_metadata(spark.read.parquet(args.metadata)), "paper_id", "left")
        write_records(format_record(papers.withColumn("attachments", F.lit(None).cast("array<string>"))), f"{args.out}/records")
    else:
        papers = papers.withColumn("title", F.lit(None).cast("string"))
    made = stored(guides(files, papers if args.metadata else None, terms, pairs), "guides")
    made.write.parquet(f"{args.out}/guides")
    translator = RemoteTranslator(config) if config else DictionaryTranslator(pairs)
    done, messages = translate_papers(files, made, translator, args.cache, args.chunk_chars, max(0, args.context_chars), terms, pairs, max(1, args.parallel_chunks) if config else None)
    mains = main_files(files).select("paper_id", "path", F.col("text").alias("original"))
    write_texts(finish_sources(done, mains, papers, args.merge_citations, args.superscript_citations), f"{args.out}/sources")
    warning_report(messages).write.parquet(f"{args.out}/reports")
    return 0


if __name__ == "__main__":
    sys.exit(main())
