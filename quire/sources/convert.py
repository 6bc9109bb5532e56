"""Files into PDF and PDF into better PDF: images, HTML, Markdown, repair, sanitising, attachments, metadata."""

from __future__ import annotations

import re
from typing import Any

from quire.sources import pdf_edit
from quire.sources.html import markdown_html, plain_text
from quire.sources.pdf import Name, Ref, Stream
from quire.sources.pdf_edit import Draft
from quire.sources.pdf_write import file_bytes, image_object, text_pdf

LINES_A_PAGE, COLUMNS = 45, 90


def wrapped(text: str) -> list[str]:
    """Text as pages of lines that fit."""
    import textwrap

    lines = [part for line in text.split("\n") for part in (textwrap.wrap(line, COLUMNS) or [""])]
    return ["\n".join(lines[i : i + LINES_A_PAGE]) for i in range(0, len(lines), LINES_A_PAGE)] or [""]


def from_html(text: str, title: str | None = None) -> bytes:
    """What an HTML page shows, as a text document."""
    found = re.search(r"(?is)<title>(.*?)</title>", text)
    return text_pdf(wrapped(plain_text(text)), title=title if title is not None else (found[1].strip() if found else None))


def from_markdown(text: str, title: str | None = None) -> bytes:
    return from_html(markdown_html(text), title)


def from_images(images: list[bytes]) -> bytes:
    """A page for each image, at its own size."""
    objects: list[Any] = [{"Type": Name("Catalog"), "Pages": Ref(2, 0)}, None]
    kids = []
    for data in images:
        image = image_object(data)
        width, height, n = image.dict["Width"], image.dict["Height"], len(objects) + 1
        objects.append(image)
        objects.append(Stream({}, b"q %d 0 0 %d 0 0 cm /I Do Q" % (width, height)))
        objects.append({"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, width, height], "Resources": {"XObject": {"I": Ref(n, 0)}}, "Contents": Ref(n + 1, 0)})
        kids.append(Ref(n + 2, 0))
    objects[1] = {"Type": Name("Pages"), "Count": len(kids), "Kids": kids}
    return file_bytes(objects)


def repaired(data: bytes) -> bytes:
    """The file's pages, what its catalog carries and its information written anew."""
    return Draft(data).save()


def compressed(data: bytes) -> tuple[bytes, float]:
    """The file written anew without what nothing reaches, its streams deflated, or as it was if that is not smaller; and the ratio."""
    draft = Draft(data)
    pdf_edit.compress(draft)
    new = draft.save()
    kept = new if len(new) < len(data) else data
    return kept, round(len(kept) / max(len(data), 1), 3)


def sanitized(data: bytes) -> tuple[bytes, int]:
    """The file without scripts, automatic actions, attached files, metadata and thumbnails, and how many entries went."""
    draft = Draft(data)
    removed = pdf_edit.sanitize(draft)
    return draft.save(), removed


def with_attachment(data: bytes, name: str, content: bytes) -> bytes:
    """The file with one more attached file; a name that is taken is an error."""
    draft = Draft(data)
    pdf_edit.attach(draft, name, content)
    return draft.save()


def with_information(data: bytes, changes: dict[str, str]) -> bytes:
    """The file with information entries set; an empty text, none or null deletes one."""
    draft = Draft(data)
    pdf_edit.set_information(draft, changes)
    return draft.save()
