"""Small archives made for tests: a sound one, and ways to break it."""

from __future__ import annotations

import copy
import hashlib
import io
import json
import zipfile

import numpy as np

#: Name of the manifest's version key.
VERSION_KEY = "format_version"


def atom(symbol, z, *xyz):
    return {"symbol": symbol, "atomic_number": z, "position": list(xyz)}


def water() -> dict:
    """section list and payloads of a molecule with bonds, a grid, a spectrum, forces and a run."""
    atoms = [atom("O", 8, 0.0, 0.0, 0.0), atom("H", 1, 0.96, 0.0, 0.0), atom("H", 1, -0.24, 0.93, 0.0)]
    return {
        "sections": [
            {"id": "mol", "kind": "structure", "charge": 0, "multiplicity": 1, "members": {"structure": {"atoms": atoms, "pbc": [False, False, False]}, "bonds": {"pairs": [{"i": 0, "j": 1}, {"i": 0, "j": 2}]}}},
            {"id": "rho", "kind": "volume.density", "structure_ref": "mol", "members": {"grid": {"origin": [0, 0, 0], "shape": [2, 2, 2], "structure_ref": "mol"}, "data": np.arange(8.0).reshape(2, 2, 2)}},
            {"id": "ir", "kind": "spectra.ir", "members": {"spectrum": {"frequencies": [1.0, 2.0], "intensities": [3.0, 4.0]}}},
            {"id": "run", "kind": "run.record", "members": {"log": b"done on host7\n", "files": {"log": {"name": "out.log"}}}},
        ],
    }


def build(spec: dict, *, manifest=None, raw=(), change=lambda m: None) -> bytes:
    """Bytes of an archive; ``raw``: further entries (name, bytes); ``change`` edits the finished manifest."""
    spec = copy.deepcopy(spec)
    out = io.BytesIO()
    listed = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, s in enumerate(spec["sections"]):
            members = {}
            for role, v in s.pop("members").items():
                if isinstance(v, np.ndarray):
                    data, m = np.ascontiguousarray(v).tobytes(), {"format": "binary", "dtype": str(v.dtype), "shape": list(v.shape)}
                elif isinstance(v, bytes):
                    data, m = v, {"format": "opaque"}
                else:
                    data, m = json.dumps(v).encode(), {"format": "json"}
                path = f"s{k}/{role}"
                z.writestr(path, data)
                members[role] = {"path": path, "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), **m}
            listed.append(s | {"members": members})
        whole = manifest or {VERSION_KEY: 1, "byte_order": "little", "source": {"program": "p", "version": "1", "calculation": "c"}, "sections": listed, **{k: v for k, v in spec.items() if k != "sections"}}
        change(whole)
        for name, data in raw:
            z.writestr(name, data)
        z.writestr("manifest.json", whole if isinstance(whole, (str, bytes)) else json.dumps(whole), zipfile.ZIP_STORED)
    return out.getvalue()
