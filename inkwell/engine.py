"""The entry points: documents to tokens, HTML and relations, under one syntax."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import blocks, flat, inlines, render, sections
from .plans.config import Syntax


@dataclass(frozen=True)
class Engine:
    """``Engine("gfm-like").render(docs)``. Immutable: every change gives a copy."""

    preset: str | dict = "commonmark"
    options: dict = field(default_factory=dict)
    syntax: Syntax | None = None
    rules: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def config(self) -> Syntax:
        return self.syntax or Syntax.preset(self.preset, **self.options)

    def enable(self, names, ignore_invalid: bool = False) -> Engine:
        return replace(self, syntax=self.config().enable(names, ignore_invalid))

    def disable(self, names, ignore_invalid: bool = False) -> Engine:
        return replace(self, syntax=self.config().disable(names, ignore_invalid))

    def enable_only(self, names, chain: str, ignore_invalid: bool = False) -> Engine:
        return replace(self, syntax=self.config().enable_only(names, chain, ignore_invalid))

    def set(self, **options) -> Engine:
        """These options alone; ``update`` changes some. Besides the presets' options: validate_link, normalize_link and normalize_link_text (functions of a URL), highlight (a function of columns content and lang), store_labels, inline_definitions."""
        return replace(self, syntax=self.config().set(**options))

    def update(self, **options) -> Engine:
        return replace(self, syntax=self.config().update(**options))

    def use(self, plugin: Callable[..., Engine], *args, **options) -> Engine:
        """A plugin takes the engine and returns a changed one."""
        return plugin(self, *args, **options)

    def add_render_rule(self, token_type: str, rule: Callable[[Column], Column]) -> Engine:
        """``rule`` gives the HTML of such tokens as an expression over the token's fields: ``lambda t: F.upper(t["content"])``."""
        return replace(self, rules=self.rules | {token_type: rule})

    def nested(self, docs: DataFrame, *, shared: DataFrame | None = None, report: bool = False, **columns) -> DataFrame:
        """(doc_id, tokens, children): a row per document; its text is folded once and its inline content scanned once, without a shuffle."""
        return inlines.nested(docs, self.config(), shared=shared, report=report, **columns)

    def parse(self, docs: DataFrame, **columns) -> DataFrame:
        """Tokens: doc_id, pos, sub and the token's columns. Columns: id_col, text_col; inline_only: the text is one inline token; shared: definitions for all documents."""
        return inlines.rows(self.nested(docs, **columns))

    def parse_inline(self, docs: DataFrame, **columns) -> DataFrame:
        return self.parse(docs, inline_only=True, **columns)

    def nested_blocks(self, docs: DataFrame, *, by_lines: bool = False, **columns) -> DataFrame:
        """(doc_id, tokens): a row per document with its block tokens. With ``by_lines`` documents without containers are parsed by expressions over their lines, without Python."""
        return flat.nested(docs, self.config(), **columns) if by_lines else blocks.nested(docs, self.config(), **columns)

    def parse_blocks(self, docs: DataFrame, types: tuple[str, ...] | None = None, **columns) -> DataFrame:
        """Block tokens alone, in the form of all tokens: inline content is not looked into. With ``types`` only tokens of these types become rows."""
        if types is None:
            return inlines.block_tokens(blocks.parse(docs, self.config(), **columns))
        wanted = F.filter("tokens", lambda t: t["type"].isin(*types))
        return self.nested_blocks(docs, **columns).select("doc_id", F.inline(wanted)).withColumn("sub", F.lit(0))

    def render(self, docs: DataFrame, **columns) -> DataFrame:
        """(doc_id, html), a row per document whatever its id; a null or blank document has an empty text. No shuffle.

        Rules that name columns (``F.col("content")``) in place of the token's fields need token rows: these are put together
        by document, which costs a shuffle.
        """
        text = columns.get("text_col", "text")
        found = self.nested(docs.withColumn(text, F.coalesce(F.col(f"`{text}`"), F.lit(""))), **columns)
        try:
            return found.select("doc_id", render.html(self.config(), self.rules).alias("html"))
        except AnalysisException:
            if not self.rules:
                raise
        numbered = found.withColumn("doc_id", F.struct(F.monotonically_increasing_id().alias("n"), F.col("doc_id").alias("id")))
        tokens = inlines.rows(numbered, outer=True)
        return render.render(tokens, self.config(), self.rules).select("doc_id.id", "html").withColumnRenamed("id", "doc_id")

    def sections(self, docs: DataFrame, **columns) -> DataFrame:
        """(doc_id, section, first_line, tokens, children): long documents as several rows, so that many tasks share one; lines and definitions are those of the whole document."""
        return sections.nested(docs, self.config(), **columns)

    def render_sections(self, docs: DataFrame, **columns) -> DataFrame:
        """(doc_id, section, html): the HTML of a document in pieces, in the order of ``section``."""
        return self.sections(docs, **columns).select("doc_id", "section", render.html(self.config(), self.rules).alias("html"))

    def render_inline(self, docs: DataFrame, **columns) -> DataFrame:
        """(doc_id, html) of texts without blocks."""
        return self.render(docs, inline_only=True, **columns)

    def definitions(self, docs: DataFrame, **columns) -> DataFrame:
        return inlines.definitions(blocks.parse(docs, self.config(), **columns))

    def unresolved_references(self, docs: DataFrame, **columns) -> DataFrame:
        """(doc_id, label) of full references ``[text][label]`` that no definition names."""
        found = self.nested(docs, report=True, **columns).select("doc_id", F.explode(F.flatten("children")).alias("c"))
        return found.where(F.col("c.type") == inlines.UNRESOLVED).select("doc_id", F.col("c.content").alias("label")).distinct()
