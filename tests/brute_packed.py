"""A plain character-by-character reading of the packed notation, for comparison only."""

from urllib.parse import unquote

MARKS = ";&|\t\n\r"


def parse(text):
    """[(pos, key, value)] of the non-empty values."""
    if text is None or text.strip(" ") in ("", "."):
        return []
    out, pos, i, n = [], 0, 0, len(text)

    def quoted(j):
        """Text of a quoted value that opens at j, and the place after its end."""
        mark, j, got = text[j], j + 1, ""
        while j < n:
            if text[j] == "\\" and j + 1 < n and text[j + 1] == mark:
                got, j = got + mark, j + 2
            elif text[j] == mark:
                if j + 1 < n and text[j + 1] == mark:
                    got, j = got + mark, j + 2
                else:
                    return got, j + 1
            else:
                got, j = got + text[j], j + 1
        return got, n

    while i < n:
        j, named = i, False
        while j < n and text[j] not in MARKS:
            if text[j] == "=":
                named = True
                break
            if text[j] in "\"'" and j > i and text[j - 1] in " ," and text[i:j].strip(" "):
                break
            j += 1
        if named:
            key, i = text[i:j].strip(" "), j + 1
        else:
            while i < n and text[i] == " ":
                i += 1
            j = i
            while j < n and text[j] not in MARKS and text[j] not in " ,":
                j += 1
            key, i = text[i:j], j
            while i < n and text[i] == " ":
                i += 1
            if i >= n or text[i] in MARKS:
                i += 1
                continue
        while True:  # one value
            while i < n and text[i] == " ":
                i += 1
            value = ""
            if i < n and text[i] in "\"'":
                value, i = quoted(i)
            bare = ""
            while i < n and text[i] not in MARKS and text[i] != "," and (named or text[i] != " "):
                bare, i = bare + text[i], i + 1
            value += bare.rstrip(" ")
            pos += bool(key)
            while i < n and text[i] == " ":
                i += 1
            if key and value:
                out.append((pos, key, unquote(value, errors="replace")))
            if i >= n or text[i] in MARKS:
                i += 1
                break
            if text[i] == ",":
                i += 1
    return out
