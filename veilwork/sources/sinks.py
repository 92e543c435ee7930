"""Sinks: redacted text, legend and key, scores."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame


def write_redacted(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_labels(legend: DataFrame, key: DataFrame, legend_path: str, key_path: str) -> None:
    """The legend may be published; the key holds the values and is written
    apart. Refuses a legend with a column of values."""
    if "value" in legend.columns or legend_path == key_path:
        raise ValueError("the legend must not carry values or share the key's place")
    legend.write.mode("overwrite").parquet(legend_path)
    key.write.mode("overwrite").parquet(key_path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pdf_bytes(pages: list[tuple[int, int, bytes, str]]) -> bytes:
    """A PDF of pictures: (width, height, RGB bytes, invisible text) a page.
    Cross-reference rows are 20 bytes each."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", b"<< /Producer (veilwork) >>"]
    kids = []
    for w, h, rgb, text in pages:
        n = len(objects) + 1
        kids.append(f"{n} 0 R")
        safe = text.encode("cp1252", "ignore").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        content = f"q {w} 0 0 {h} 0 0 cm /I Do Q\n".encode() + (b"BT 3 Tr /F 8 Tf (" + safe + b") Tj ET\n" if safe else b"")
        image = zlib.compress(rgb)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w} {h}] /Contents {n + 1} 0 R /Resources << /XObject << /I {n + 2} 0 R >> /Font << /F 3 0 R >> >> >>".encode())
        objects.append(f"<< /Length {len(content)} >>\nstream\n".encode() + content + b"endstream")
        objects.append(f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length {len(image)} >>\nstream\n".encode() + image + b"\nendstream")
    objects[1] = f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(kids)}] >>".encode()
    out, offsets = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        offsets.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    at = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode()
    for o in offsets:
        out += f"{o:010d} 00000 n \n".encode()
    out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R /Info 4 0 R >>\nstartxref\n{at}\n%%EOF\n".encode()
    return bytes(out)
