"""Small notes that workers leave each other in a shared folder: one JSON file for each key, whole or not there."""

from __future__ import annotations

import functools
import json
import posixpath
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs


@functools.lru_cache(16)
def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@dataclass
class Notes:
    """Notes under a folder that pyarrow names by a URI."""

    uri: str

    def _at(self, key: str) -> tuple[pafs.FileSystem, str]:
        store, at = _opened(self.uri)
        return store, f"{at}/{key[:2]}/{key}.json"

    def get(self, key: str) -> object | None:
        store, path = self._at(key)
        if store.get_file_info(path).type != pafs.FileType.File:
            return None
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def put(self, key: str, value: object) -> None:
        store, path = self._at(key)
        draft = f"{posixpath.dirname(path)}/.{uuid.uuid4().hex}"  # hidden from readers until it is whole
        try:
            out = store.open_output_stream(draft)
        except FileNotFoundError:  # the first note of its folder
            store.create_dir(posixpath.dirname(path), recursive=True)
            out = store.open_output_stream(draft)
        with out as f:
            f.write(json.dumps(value, ensure_ascii=False).encode())
        store.move(draft, path)
