"""Source trees written for tests."""

import os


def write_tree(root: str, files: dict[str, str | bytes]) -> str:
    for rel, content in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        mode = "wb" if isinstance(content, bytes) else "w"
        with open(p, mode, **({} if isinstance(content, bytes) else {"newline": ""})) as f:
            f.write(content)
    return root
