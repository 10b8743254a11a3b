"""Result sentences, each built from a run's own counts.

All wording in this file is fixed values: it is what a reader is shown, one branch per case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def merged(pages_text: Column, files: Column, bookmarks: Column, sizes_text: Column, n_sizes: Column, fields: Column, renamed: Column) -> Column:
    marks = F.when(bookmarks > 0, _text(S.plural(bookmarks, "bookmark"), " kept, in ", S.plural(files, "group"), ".")).otherwise("No bookmarks: none of the files had any.")
    size = F.when(n_sizes > 1, _text("Page sizes ", sizes_text, ", all kept as they were.")).otherwise(_text("Page size ", F.coalesce(sizes_text, F.lit("unknown")), ", unchanged."))
    clash = F.when(renamed > 0, _text(", ", renamed, " renamed to avoid a clash")).otherwise("")
    form = F.when(fields > 0, _text(S.plural(fields, "form field"), " kept", clash, ".")).otherwise("No form fields in these files.")
    return F.concat_ws(" ", _text(pages_text, " pages, in the order you set."), marks, size, form)


def split(pages_text: Column, parts: Column, pages: Column, total: Column) -> Column:
    head = F.when(parts == 1, _text(S.plural(pages, "page"), ", ", total, ".")).otherwise(_text(pages_text, " pages, ", total, " in total."))
    return _text(head, " Your original file is untouched, on your disk, where it was.")


def images_to_pdf(images: Column, converted: Column, max_w: Column, max_h: Column, had: Column, stripped: Column, page_size: Column) -> Column:
    size = F.when(page_size.isNull(), F.lit("Each page matches its image.")).otherwise(_text("Every page is ", page_size, "."))
    res = F.when(converted > 0, _text("Largest image ", max_w, " × ", max_h, "; ", converted, " converted.")).otherwise(_text("Images unchanged, the largest ", max_w, " × ", max_h, "."))
    exif = (F.when(had == 0, F.lit("None of these carried photo EXIF."))
            .when(stripped, _text("Photo EXIF (GPS coordinates, phone model, capture time) removed from ", had, " of ", images, "."))
            .otherwise(_text("Photo EXIF kept on ", had, " of ", images, ".")))
    return F.concat_ws(" ", size, res, exif)


def rotated(in_label: Column, out_label: Column, drift: Column) -> Column:
    return _text("Every page is still here, and no image was re-encoded. ", in_label, " in, ", out_label, " out (", drift, ").")


def reordered(in_label: Column, out_label: Column, pages: Column, kept: Column, had_outline: Column, bookmarks: Column) -> Column:
    tail = F.when(had_outline & (bookmarks > 0), _text(S.plural(bookmarks, "bookmark"), " kept.")).when(had_outline, F.lit("Bookmarks dropped: their pages are gone."))
    return F.concat_ws(" ", _text(pages, " → ", kept, " pages, and no image re-encoded. ", in_label, " in, ", out_label, " out."), tail)


def merged_size(before: Column, after: Column) -> tuple[Column, Column]:
    fact = _text(S.format_bytes(before), " in, ", S.format_bytes(after), " out")
    note = _text("The merged file is ", S.format_bytes(after - before), " larger than the files you gave it add up to. ",
                 "Merging copies each page’s images and fonts exactly as they are, so it cannot win those bytes back — Compress is the tool that tries.")
    return fact, F.when(after <= before, F.lit("")).otherwise(note)


def compressed(recompressed: Column, quality: Column, downscaled: Column, dpi: Column, kept: Column, undecodable: Column, stripped: Column) -> Column:
    to = F.when(dpi > 0, _text(" to about ", dpi, " dpi")).otherwise("")
    scaled = F.when(downscaled == 0, F.lit("")).when(downscaled == recompressed, _text(" and downscaled", to)).otherwise(_text(", ", downscaled, " of them downscaled", to))
    did = F.when(recompressed > 0, _text(S.plural(recompressed, "image"), " re-encoded at quality ", quality, scaled))
    left = F.when(kept > 0, _text(S.plural(kept, "image"), " left as ", S.pick(kept, "it was", "they were"), ", because re-encoding would not have made ", S.pick(kept, "it", "them"), " smaller"))
    bad = F.when(undecodable > 0, _text(S.plural(undecodable, "image"), " this browser could not read, left as ", S.pick(undecodable, "it was", "they were")))
    parts = F.concat_ws("; ", did, left, bad)
    head = F.when(parts == "", F.lit("No images to change.")).otherwise(_text(parts, "."))
    return _text(head, " Text, vectors and form fields copied byte-for-byte. ", F.when(stripped, "Author and timestamps removed.").otherwise("Metadata kept as it was."))


def recognised_head(read: Column, pages: Column) -> Column:
    return F.when(read == 0, F.lit("No text could be read from this document.")).otherwise(
        _text("The text was read from ", read, " of ", pages, " ", S.pick(pages, "page", "pages"), "."))


def recognised_announce(read: Column, pages: Column, from_layer: Column) -> Column:
    tail = F.when(from_layer > 0, _text(" ", from_layer, " came from the document's own text layer.")).otherwise("")
    return F.when(read == 0, F.lit("No text could be read.")).otherwise(_text("Text read from ", read, " of ", pages, " pages.", tail))


def searchable_head(pages: Column, from_layer: Column, layered: Column) -> Column:
    """NULL when no page was given a layer: such a copy cannot be called searchable."""
    are = S.pick(pages, "page is", "pages are")
    own = _text(from_layer, " already had ", S.pick(from_layer, "its", "their"), " own")
    return F.when(layered == 0, F.lit(None)).when(from_layer > 0, _text(
        layered + from_layer, " of ", pages, " ", are, " searchable in the saved copy: ", layered, " given a text layer here, ", own, ".")).otherwise(
        _text(layered, " of ", pages, " ", are, " now searchable."))


def resolution(dpi: int, downscaled: Column, at_or_below: Column, unknown: Column, cannot: Column, stayed: Column) -> Column:
    bits = F.concat_ws("; ", _text(S.plural(downscaled, "image"), f" brought down to {dpi} dpi"),
                       F.when(at_or_below > 0, _text(at_or_below, " already at or below it left as ", S.pick(at_or_below, "it was", "they were"))),
                       F.when(unknown > 0, _text(unknown, " with no measurable resolution left alone")),
                       F.when(cannot > 0, _text(cannot, " in a form this cannot re-encode left alone")))
    tail = F.when(stayed > 0, _text(" ", S.plural(stayed, "image"), f" stayed above {dpi} dpi, because resizing ", S.pick(stayed, "it", "them"), " would not have made the file smaller.")).otherwise("")
    return _text(bits, ".", tail)


def size_answer(kind: Column, target: Column, size: Column, floor_size: Column, step: Column, ladder: list[tuple[int, float]]) -> Column:
    def exact(n):
        return _text(F.format_number(n, 0), " bytes")
    words = None
    for i, (dpi, q) in enumerate(ladder):
        w = F.lit(f"{dpi} dpi, quality {int(q * 100 + 0.5)}")
        words = F.when(step == i, w) if words is None else words.when(step == i, w)
    floor = f"{ladder[-1][0]} dpi, quality {int(ladder[-1][1] * 100 + 0.5)}"
    return (F.when(kind == "already", _text("This file is already ", S.format_bytes(size), " (", exact(size), "), which is under ", S.format_bytes(target), ". There is nothing to do."))
            .when(kind == "cannot", _text("This file can't be brought under ", S.format_bytes(target), f" here. At our harshest setting — {floor} — it comes to ", S.format_bytes(floor_size), " (", exact(floor_size), ")."))
            .otherwise(_text("Under ", S.format_bytes(target), ": ", S.format_bytes(size), " (", exact(size), ") at ", words, " — the mildest setting that got there.")))


def no_gain(images: Column, usable: Column, all_jpeg: Column, quality: Column, dpi: Column, skipped: Column, actionable: Column, reason: Column,
            lever: Column, setting: str, smallest_quality: int, smallest_dpi: int, fonts: Column, total: Column, has_text: Column) -> Column:
    """Why a document could not get smaller, from what it holds."""
    font = F.when(fonts > 0, _text(" ", S.format_bytes(fonts), " of its ", S.format_bytes(total),
                                   " is embedded fonts, which this tool does not rewrite. That is a limit of this tool, not a finding about the file.")).otherwise("")
    only = "images are the only thing this tool shrinks"
    empty = (F.when(fonts > 0, _text(f"It holds no images, and {only}.", font))
             .when(has_text, F.lit(f"It holds no images, and {only}. Its text and drawing are copied byte-for-byte, so there was nothing here for it to work on."))
             .otherwise(F.lit(f"It holds no images and no text, and {only}, so there was nothing here for it to work on.")))
    none = _text("Its ", F.when(images == 1, F.lit("one image is")).otherwise(_text(images, " images are")), " ", F.coalesce(reason, F.lit("not in a form we rebuild")),
                 ". Recompressing ", S.pick(images, "it", "them"), " would add bytes rather than remove them.", F.when(fonts > skipped, font).otherwise(""))
    rounded = S.js_round(dpi).cast("long")
    facts = F.concat_ws(" ", _text("Its ", F.when(usable == 1, F.lit("one image is")).otherwise(_text(usable, " images are")), " already ", F.when(all_jpeg, "JPEG").otherwise("compressed")),
                        F.when(quality.isNotNull(), _text("at quality ", quality)),
                        F.when(dpi.isNotNull(), _text(F.when(quality.isNotNull(), "and ").otherwise("at "), rounded, " dpi")))
    tail = F.when(fonts > actionable, font).when(skipped > actionable, F.lit(" Most of its image data is in images this tool leaves alone.")).otherwise("")
    left = F.when(lever == "none", _text(f" Our Smallest setting would not change it either: it targets quality {smallest_quality} at {smallest_dpi} dpi, and this file is already at quality ", quality, " and ", rounded, " dpi.")
                  ).otherwise(" We could hand you a visibly worse file for a few kilobytes, but that is not an improvement, so we are telling you instead.")
    some = _text(facts, f" — close to what our {setting} setting would produce.", tail, left)
    return F.when(images == 0, empty).when(usable == 0, none).otherwise(some)
