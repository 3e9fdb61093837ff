"""File-search filters: the query grammar, extensions, kinds and paths."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by kind.
KIND_EXTS = {
    "document": ["pdf", "doc", "docx", "odt", "rtf", "txt", "md", "xls", "xlsx", "ods", "csv", "ppt", "pptx", "odp"],
    "image": ["png", "jpg", "jpeg", "gif", "webp", "bmp", "svg", "heic", "tif", "tiff", "ico"],
    "audio": ["mp3", "flac", "wav", "m4a", "aac", "ogg", "opus", "wma"],
    "video": ["mp4", "mkv", "mov", "avi", "webm", "m4v", "wmv"],
    "archive": ["zip", "7z", "rar", "tar", "gz", "bz2", "xz", "zst", "iso"],
}
#: What a request may hold.
MOST_QUERY_BYTES, MOST_EXTS, MOST_EXT_BYTES, MOST_PATH_BYTES = 1024, 64, 1024, 1024


def normalized_ext(ext: str) -> str:
    """Lower case with one leading dot; '' for nothing."""
    plain = ext.strip().lstrip(".").lower()
    return f".{plain}" if plain else ""


def ext_filter(name: Column, exts: list[str]) -> Column:
    """Names that end in one of the extensions, as suffixes; no extensions let all pass."""
    wanted = [e for e in map(normalized_ext, exts) if e]
    out = F.lit(not wanted)
    for e in wanted:
        out = out | F.endswith(F.lower(name), F.lit(e))
    return out


def path_filter(parent_path: Column, part: str | Column) -> Column:
    needle = F.lit(part.lower()) if isinstance(part, str) else F.lower(part)
    return F.contains(F.lower(parent_path), needle)


def valid_request(text: Column, exts: Column, path: Column) -> Column:
    """Requests that are answered; others get an empty page."""
    return (
        (F.octet_length(text) <= MOST_QUERY_BYTES) & (text != "") & (F.size(exts) <= MOST_EXTS)
        & F.forall(exts, lambda e: F.octet_length(e) <= MOST_EXT_BYTES) & (F.octet_length(F.coalesce(path, F.lit(""))) <= MOST_PATH_BYTES)
    )


@dataclass
class FileQuery:
    """A parsed query: words, filters, or why it is refused; pending names a filter that is only half typed."""

    name: str = ""
    exts: list[str] = field(default_factory=list)
    path: str = ""
    kind: str = ""
    refused: str = ""
    pending: list[str] = field(default_factory=list)


def _kind_or_refusal(value: str) -> tuple[str, str]:
    """The kind that value names, '' while it is still being typed; and why it is refused."""
    if value == "folder":
        return "", "folders cannot be told apart"
    if value in KIND_EXTS:
        return value, ""
    return "", "" if any(k.startswith(value) for k in KIND_EXTS) else f"no kind is called {value}"


def parse_file_query(text: str) -> FileQuery:
    """Words and the tokens ext:, path: and kind:.

    ext adds up; of path and kind the last that is whole holds; kind and ext
    intersect.  The first kind that cannot be refuses the query, whatever
    follows.  One letter before a colon is a drive, and belongs to the words.
    """
    out, words, listed = FileQuery(), [], []
    for token in text.split():
        key, colon, value = token.partition(":")
        key = key.lower()
        if not colon or key not in ("ext", "path", "kind"):
            words.append(token)
        elif key == "ext":
            found = [e for e in (x.strip().lstrip(".").lower() for x in value.split(",")) if e]
            listed += found
            out.pending += [] if found else ["ext"]
        elif key == "path":
            out.path = value or out.path
            out.pending += [] if value else ["path"]
        else:
            kind, refused = _kind_or_refusal(value.lower())
            if refused:
                out.refused = refused
                return out
            out.kind = kind or out.kind
            out.pending += [] if kind else ["kind"]
    out.name = " ".join(words)
    exts = list(dict.fromkeys(listed))
    if out.kind:
        own = KIND_EXTS[out.kind]
        both = [e for e in exts if e in own]
        if exts and not both:
            if not any(o.startswith(e) for e in exts for o in own):
                out.refused = "no extension is of that kind"
                return out
            out.pending.append("ext")
        exts = both or own
    out.exts = exts
    if not out.name and text.strip():
        out.refused = "a filter needs something to search for"
    return out
