"""The seven read tools: each runs one query and gives Markdown. Only results (bounded by their limits) reach the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from marginalia.operators import render, search
from marginalia.operators.postings import PostingsIndex
from marginalia.operators.store import NoteStore, newest

# The messages of the read API, here and below.
_MORE = "\n> 使用 `get_note` (ID) 或 `get_note_by_code` (视频码) 获取完整内容。"


@dataclass(frozen=True)
class NotesApi:
    """The tools over notes; ``location`` names where they are stored, ``index`` is their full-text index, if there is one. Limits and offsets must not be negative."""

    notes: DataFrame
    location: str = ""
    index: PostingsIndex | None = None

    @property
    def store(self) -> NoteStore:
        return NoteStore(self.notes, self.location)

    def search_notes(self, query: str, limit: int = 100) -> str:
        rows = search.search(self.notes, query, limit, self.index).select("place", render.search_entry().alias("x")).orderBy("place").collect()
        return "\n".join([f'## 搜索结果: "{query}" ({len(rows)} 条)\n', *(r["x"] for r in rows), _MORE]) if rows else f'未找到与 "{query}" 相关的笔记。'

    def search_notes_precise(self, query: str, limit: int = 20) -> str:
        rows = search.search_precise(self.notes, query, limit).orderBy(*newest()).select(render.search_entry().alias("x")).collect()
        return "\n".join([f'## 精确搜索: "{query}" ({len(rows)} 条)\n', *(r["x"] for r in rows), _MORE]) if rows else f'未找到同时包含所有关键词 "{query}" 的笔记。'

    def get_note(self, note_id: int) -> str:
        row = self.store.get_by_id(note_id).select(render.note_document().alias("x")).first()
        return row["x"] if row else f"❌ 未找到 ID 为 {note_id} 的笔记。"

    def get_note_by_code(self, code: str) -> str:
        row = self.store.get_by_code(code).select(render.note_document(code=True).alias("x")).first()
        return row["x"] if row else f"❌ 未找到视频码为 {code} 的笔记。"

    def list_notes(self, limit: int = 10, offset: int = 0) -> str:
        rows = self.store.list_recent(limit, offset).select(render.list_entry().alias("x")).collect()
        return "\n".join([f"## 最近笔记 (第 {offset + 1}-{offset + len(rows)} 条)\n", *(r["x"] for r in rows)]) if rows else "知识库暂无笔记。"

    def list_by_tag(self, tag: str, limit: int = 10) -> str:
        rows = self.store.list_by_tag(tag, limit).select(render.list_entry(code=False).alias("x")).collect()
        return "\n".join([f'## 标签 "{tag}" 相关笔记 ({len(rows)} 条)\n', *(r["x"] for r in rows)]) if rows else f'未找到包含标签 "{tag}" 的笔记。'

    def knowledge_stats(self) -> str:
        return self.store.stats().select(render.stats_text().alias("x")).first()["x"]
