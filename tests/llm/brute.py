"""Plain Python versions that the operators are held against."""
from collections import Counter, defaultdict


def shingles(w):
    return {tuple(w)} if len(w) < 5 else set(zip(*[w[j:] for j in range(5)]))


def classes(items, threshold=0.8):
    """Least member of each item's component under Jaccard >= threshold."""
    sets, where, root = [shingles(w) for w in items], defaultdict(list), list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in where[x])
        for j, n in both.items():
            if n / (len(s) + len(sets[j]) - n) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(i)
    return [find(i) for i in range(len(items))]
