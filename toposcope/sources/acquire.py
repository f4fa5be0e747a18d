"""Fetching source files on the driver: conditional download, checksum, archives."""

from __future__ import annotations

import hashlib
import json
import urllib.request
import zipfile
from pathlib import Path


def sha256_of(path: Path) -> str:
    h = hashlib.sha256()
    with path.open("rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def fetch(url: str, folder: str, sha256: str | None = None, opener=urllib.request.urlopen) -> Path:
    """Download unless the kept copy is still valid; a partial file never takes its place."""
    target = Path(folder) / url.rsplit("/", 1)[-1]
    target.parent.mkdir(parents=True, exist_ok=True)
    notes = target.with_name(target.name + ".http.json")
    known = json.loads(notes.read_text()) if notes.exists() and target.exists() else {}
    headers = {k: v for k, v in (("If-None-Match", known.get("etag")), ("If-Modified-Since", known.get("modified"))) if v}
    try:
        with opener(urllib.request.Request(url, headers=headers)) as answer:
            part = target.with_name(target.name + ".part")
            with part.open("wb") as out:
                while data := answer.read(1 << 20):
                    out.write(data)
            size = answer.headers.get("Content-Length")
            if size is not None and part.stat().st_size != int(size):
                part.unlink()
                raise OSError(f"{url}: {size} bytes were announced")
            if sha256 and sha256_of(part) != sha256:
                part.unlink()
                raise OSError(f"{url}: checksum differs")
            part.replace(target)
            notes.write_text(json.dumps({"etag": answer.headers.get("ETag"), "modified": answer.headers.get("Last-Modified")}))
    except urllib.error.HTTPError as e:
        if e.code != 304:
            raise
    return target


def unpack(archive: Path, wanted: str) -> Path:
    """The wanted file of a ZIP archive, extracted anew only if the archive is newer."""
    folder = archive.with_suffix("")
    if not folder.exists() or folder.stat().st_mtime < archive.stat().st_mtime:
        with zipfile.ZipFile(archive) as z:
            z.extractall(folder)
        folder.touch()
    found = sorted(p for p in folder.rglob(wanted) if p.is_file())
    if not found:
        raise FileNotFoundError(f"{wanted} is not in {archive}")
    return found[0]
