"""Deep-shallow sorting of short suffixes: multikey quicksort first, blind tries for what it leaves."""

import numpy as np

#: Multikey quicksort looks at so many 8-byte characters; groups still equal go to blind tries.
SHALLOW = 3
#: Groups below this size are finished by a plain sort of their shallow prefixes.
SMALL = 64


class BlindTrie:
    """Inner nodes are [depth, {byte: child}] and hold no text; leaves are positions in ``strings``.

    A string goes down blindly, comparing branching bytes alone, to some leaf; one comparison with that
    leaf gives the true length of the common prefix, and with it the place to branch off."""

    def __init__(self, strings):
        self.strings, self.size = strings, len(strings[0])
        self.values = [int.from_bytes(s, "big") for s in strings]
        self.root = 0
        for k in range(1, len(strings)):
            self.insert(k)

    def common(self, a, b):
        return (8 * self.size - (self.values[a] ^ self.values[b]).bit_length()) >> 3

    def insert(self, k):
        s, node = self.strings[k], self.root
        while isinstance(node, list):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        depth, branch = self.common(k, node), self.strings[node]
        above, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][s[depth]] = k
            return
        new = [depth, {branch[depth]: node, s[depth]: k}]
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]]] = new

    def ordered(self):
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def deep_order(rows, group):
    """A group with an equal shallow prefix, in order: equal suffixes share a leaf."""
    leaves = {}
    for k in group.tolist():
        leaves.setdefault(rows[k].tobytes(), []).append(k)
    if len(leaves) == 1:
        return group
    strings = list(leaves)
    trie = BlindTrie(strings)
    return np.concatenate([leaves[strings[k]] for k in trie.ordered()])


def suffix_order(rows):
    """The order of the rows of a byte matrix, each row a suffix cut at one length."""
    n, width = rows.shape
    if not n:
        return np.empty(0, np.int64)
    padded = np.zeros((n, 8 * SHALLOW), np.uint8)
    padded[:, :min(width, 8 * SHALLOW)] = rows[:, :8 * SHALLOW]
    chars = np.ascontiguousarray(padded).view(">u8").astype(np.uint64)
    out, stack = [], [(np.arange(n), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out.append(group)
        elif depth == SHALLOW:
            out.append(deep_order(rows, group))
        elif len(group) < SMALL:
            keys = chars[group, depth:].tolist()
            ranked = sorted(range(len(group)), key=keys.__getitem__)
            start = 0
            for at in range(1, len(ranked) + 1):
                if at == len(ranked) or keys[ranked[at]] != keys[ranked[start]]:
                    equal = group[ranked[start:at]]
                    out.append(equal if len(equal) == 1 else deep_order(rows, equal))
                    start = at
        else:
            char = chars[group, depth]
            first, middle, last = char[0], char[len(char) // 2], char[-1]
            pivot = max(min(first, middle), min(max(first, middle), last))
            below, equal = char < pivot, char == pivot
            above = ~(below | equal)
            for part, at in ((group[above], depth), (group[equal], depth + 1), (group[below], depth)):
                if len(part):
                    stack.append((part, at))
    return np.concatenate(out)


def common_prefixes(rows, order):
    """Length of the common prefix of each row in order with the one before it (0 for the first)."""
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        ordered = rows[order]
        differ = ordered[1:] != ordered[:-1]
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return lcp
