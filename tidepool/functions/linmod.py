"""Linear models of one small matrix; each is called on a group's rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np


def ledoit_wolf(x: np.ndarray, target: str = "identity") -> tuple[np.ndarray, float]:
    """``covariance, intensity``: the sample covariance shrunk to a multiple of the identity or to its diagonal."""
    n, p = x.shape
    x = x - x.mean(0)
    s = x.T @ x / n
    goal = np.eye(p) * np.trace(s) / p if target == "identity" else np.diag(np.diag(s))
    q = (x * x).T @ (x * x) / n - s * s
    noise = q.sum() if target == "identity" else q.sum() - np.trace(q)
    distance = ((s - goal) ** 2).sum()
    intensity = float(np.clip(noise / n / distance, 0, 1)) if distance > 0 else 1.0
    return (1 - intensity) * s + intensity * goal, intensity


def lda(x: np.ndarray, y: np.ndarray, shrinkage: float | str = "auto", priors: tuple[float, float] | None = None, target: str = "identity") -> tuple[np.ndarray, float]:
    """``coefficients, intercept`` of a two-class linear discriminant with a shrunk within-class covariance.

    ``auto`` shrinks each class by Ledoit and Wolf on standardised features and weights them by the priors; a number is the
    share of the mean variance on the diagonal.
    """
    ones = y == 1
    share = priors or ((~ones).mean(), ones.mean())
    cov = np.zeros((x.shape[1],) * 2)
    for part, weight in zip((x[~ones], x[ones]), share, strict=True):
        if shrinkage == "auto":
            sd = part.std(0)
            sd[sd == 0] = 1
            cov += weight * ledoit_wolf((part - part.mean(0)) / sd, target)[0] * sd[:, None] * sd
        else:
            s = np.cov(part.T, bias=True).reshape(cov.shape)
            cov += weight * ((1 - shrinkage) * s + shrinkage * np.trace(s) / len(s) * np.eye(len(s)))
    means = np.array([x[~ones].mean(0), x[ones].mean(0)])
    w = np.linalg.lstsq(cov, means.T, rcond=None)[0].T
    b = -0.5 * (means * w).sum(1) + np.log(share)
    return w[1] - w[0], float(b[1] - b[0])


class Moments:
    """Sums of products of ``1, x - center, (x - center)**2`` over rows: all that shrunk discriminants need of a class, whatever its number of rows."""

    def __init__(self, center: np.ndarray, gram: np.ndarray) -> None:
        self.center, self.gram = center, gram

    @classmethod
    def of(cls, x: np.ndarray, center: np.ndarray | None = None) -> "Moments":
        center = x.mean(0) if center is None else center
        u = powers(x - center)
        return cls(center, u.T @ u)

    def moved(self, center: np.ndarray) -> "Moments":
        """The same rows about another center."""
        d, p = self.center - center, len(center)
        t = np.eye(2 * p + 1)
        t[1 : p + 1, 0], t[p + 1 :, 0] = d, d * d
        t[np.arange(p + 1, 2 * p + 1), np.arange(1, p + 1)] = 2 * d
        return Moments(center, t @ self.gram @ t.T)

    def scaled(self, sd: np.ndarray) -> "Moments":
        """The same rows over ``sd``, about zero."""
        f = np.concatenate([[1], 1 / sd, 1 / sd**2])
        return Moments(np.zeros(len(sd)), self.gram * f[:, None] * f)

    @staticmethod
    def added(parts: list["Moments"]) -> "Moments":
        """All parts' rows about their common mean."""
        n = np.array([m.gram[0, 0] for m in parts])
        own = np.array([m.center + m.gram[0, 1 : len(m.center) + 1] / m.gram[0, 0] for m in parts])
        center = n @ own / n.sum()
        return Moments(center, sum(m.moved(center).gram for m in parts))


def powers(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, x * x])


def _discriminants(classes: list[tuple], priors: tuple[float, float] | None, target: str) -> tuple[np.ndarray, np.ndarray]:
    """``coefficients, intercepts`` of stacked problems from each class's ``n, means, covariances, norms, quartic``.

    ``norms``: mean squared length of standardised rows, squared; ``quartic``: their mean fourth powers, summed over features; the rest is Ledoit and Wolf's.
    """
    total = classes[0][0] + classes[1][0]
    cov, floor = np.zeros(classes[0][2].shape), 0.0
    for i, (n, _, s, norms, quartic) in enumerate(classes):
        share = priors[i] if priors else n / total
        v = np.diagonal(s, axis1=1, axis2=2)
        sd2 = np.where(v > 0, v, 1.0)
        g = 1 / sd2
        c2 = (g * np.matmul(s * s, g[:, :, None])[..., 0]).sum(1)
        diag = v / sd2
        if target == "identity":
            mu = diag.mean(1)
            noise, distance = norms - c2, c2 - mu * mu * v.shape[1]
        else:
            noise, distance = norms - c2 - (quartic - (diag * diag).sum(1)), c2 - (diag * diag).sum(1)
        apart = distance > 1e-12
        intensity = np.where(apart, np.clip(noise / n / np.where(apart, distance, 1), 0, 1), 1.0)
        at = np.arange(v.shape[1])
        share = np.broadcast_to(share, n.shape)
        part = (share * (1 - intensity))[:, None, None] * s
        part[:, at, at] += (share * intensity)[:, None] * (mu[:, None] * sd2 if target == "identity" else v)
        cov += part
        floor = floor + share * intensity * ((mu if target == "identity" else 1.0) * (sd2 if target == "identity" else v).min(1))
    (n0, m0, *_), (n1, m1, *_) = classes
    d = m1 - m0
    sound = floor > 1e-10 * np.diagonal(cov, axis1=1, axis2=2).max(1)
    w = np.empty_like(d)
    w[sound] = np.linalg.solve(cov if sound.all() else cov[sound], d[sound][:, :, None])[..., 0]
    for i in np.flatnonzero(~sound):
        w[i] = np.linalg.lstsq(cov[i], d[i], rcond=None)[0]
    ratio = np.log(priors[1] / priors[0]) if priors else np.log(n1 / n0)
    return w, ratio - (w * (m0 + m1)).sum(1) / 2


def _positive(v: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Variances, those that are nothing but rounding as zero."""
    return np.where(v > 1e-13 * np.maximum(second, 1e-300), v, 0.0)


#: Numbers in the covariances that ``folded_lda`` solves at once, so that they stay near the processor.
FOLDED = 160_000
#: Features up to which ``folded_lda`` has an array for each number of a problem, and how many problems one takes.
FEW, PROBLEMS = 8, 40_000


def stacked_lda(x: np.ndarray, ones: np.ndarray, train: np.ndarray, priors: tuple[float, float] | None = None, target: str = "identity") -> tuple[np.ndarray, np.ndarray]:
    """``coefficients, intercepts`` of ``lda`` with ``auto`` shrinkage for each row of ``train``, which marks its rows of x, and of ``ones``, their classes.

    The products of features are formed once; each problem's sums are one product with them, and all problems are solved together.
    """
    center = x.mean(0)
    x = x - center
    b, p = len(train), x.shape[1]
    products, square = (x[:, :, None] * x[:, None]).reshape(len(x), -1), x * x
    classes = []
    for weight in ((train & ~ones).astype(float), (train & ones).astype(float)):
        n = weight.sum(1)
        m, second = weight @ x / n[:, None], (weight @ products).reshape(b, p, p) / n[:, None, None]
        s = second - m[:, :, None] * m[:, None]
        at = np.arange(p)
        v = s[:, at, at] = _positive(s[:, at, at], second[:, at, at])
        g = 1 / np.where(v > 0, v, 1.0)
        r = g @ square.T - 2 * (m * g) @ x.T + (m * m * g).sum(1)[:, None]
        quartic = 0.0
        if target != "identity":
            third, fourth = weight @ (square * x) / n[:, None], weight @ (square * square) / n[:, None]
            quartic = (g * g * (fourth - 4 * m * third + 6 * m * m * second[:, at, at] - 3 * m**4)).sum(1)
        classes.append((n, m, s, (weight * r * r).sum(1) / n, quartic))
    w, intercept = _discriminants(classes, priors, target)
    return w, intercept - w @ center


def folded_lda(x: np.ndarray, ones: np.ndarray, trained: np.ndarray, priors: tuple[float, float] | None = None, target: str = "identity") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``coefficients, intercepts, fitted`` (``permutations x folds``) of ``stacked_lda`` for each row of ``ones`` and of ``trained``; what has no two classes isn't fitted.

    A fold's sums are those of all rows less its own, so a permutation's products are summed once for all folds. Of few features shrunk to their
    diagonal, all folds are solved at once (``_few_features``).
    """
    x = x - (center := x.mean(0))
    if target == "diagonal" and x.shape[1] <= FEW:
        return _few_features(x, center, ones, trained, priors)
    p, perms, marks = x.shape[1], len(ones), ones.astype(float)
    at, square = np.arange(p), x * x
    products = (x[:, :, None] * x[:, None]).reshape(len(x), -1)
    fit = np.array([(ones @ trained.T) > 0, (~ones @ trained.T) > 0, np.broadcast_to(trained.sum(1) >= 3, (perms, len(trained)))]).all(0)
    w, b = np.zeros((perms, len(trained), p)), np.zeros((perms, len(trained)))
    all_rows, all_ones, some = products.sum(0), marks @ products, max(FOLDED // (p * p), 1)
    for fold, train in enumerate(trained):
        away = np.flatnonzero(~train)
        held, kept, kept_square = products[away], x[train], square[train]
        whole, fitted = all_rows - held.sum(0), np.flatnonzero(fit[:, fold])
        for lo in range(0, len(fitted), some):
            mine = fitted[lo : lo + some]
            first = marks[mine][:, away] @ held
            np.subtract(all_ones[mine], first, out=first)
            positive = marks[mine][:, train]
            classes = []
            for s, weight in ((whole - first, 1 - positive), (first, positive)):
                count, s = weight.sum(1), s.reshape(-1, p, p)
                s /= count[:, None, None]
                m, second = weight @ kept / count[:, None], s[:, at, at]
                s -= m[:, :, None] * m[:, None]
                v = s[:, at, at] = _positive(s[:, at, at], second)
                g = 1 / np.where(v > 0, v, 1.0)
                r = g @ kept_square.T - 2 * (m * g) @ kept.T + (m * m * g).sum(1)[:, None]
                quartic = 0.0
                if target != "identity":
                    third, fourth = weight @ (kept_square * kept) / count[:, None], weight @ (kept_square * kept_square) / count[:, None]
                    quartic = (g * g * (fourth - 4 * m * third + 6 * m * m * second - 3 * m**4)).sum(1)
                classes.append((count, m, s, (weight * r * r).sum(1) / count, quartic))
            made, intercept = _discriminants(classes, priors, target)
            w[mine, fold], b[mine, fold] = made, intercept - made @ center
    return w, b, fit


def _sums(trained: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What sums values (``rows``) times weights (``permutations x rows``) over each fold's rows: ``permutations x folds``; many rows by running sums, if those left out lie together."""
    n = trained.shape[1]
    away = ~trained
    lo, count = np.where(away.any(1), away.argmax(1), 0), away.sum(1)
    hi = lo + count
    if n <= 64 or not all(out[a:b].all() for out, a, b in zip(away, lo, hi, strict=True)):
        marks = trained.T.astype(float)
        return lambda weight, values: (weight * values) @ marks

    def running(weight: np.ndarray, values: np.ndarray) -> np.ndarray:
        until = np.zeros((len(weight), n + 1))
        np.cumsum(weight * values, axis=1, out=until[:, 1:])
        return until[:, -1:] - (until[:, hi] - until[:, lo])

    return running


def _few_features(x: np.ndarray, center: np.ndarray, ones: np.ndarray, trained: np.ndarray, priors: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``folded_lda`` of centered ``x`` with few features, shrunk to their diagonal: a number of each problem (a permutation's fold) is an array, so none is formed by itself.

    Its covariances' and fourth moments' sums are those of products of features. Where a variance is small beside its mean's square, rounding would tell in these:
    there they are taken about the means. Covariances without an inverse give the least coefficients, and what rounding adds to their rank isn't used.
    """
    (n, p), (perms, folds) = x.shape, (len(ones), len(trained))
    sums, size = _sums(trained), trained.sum(1)
    w, b, fit = np.zeros((perms, folds, p)), np.zeros((perms, folds)), np.zeros((perms, folds), bool)
    pairs = [(j, k) for j in range(p) for k in range(j + 1, p)]
    for lo in range(0, perms, some := max(PROBLEMS // folds, 1)):
        own = ones[lo : lo + some]
        made, counts = [], [sums(part.astype(float), np.ones(n)) for part in (~own, own)]
        fit[lo : lo + some] = (counts[0] > 0) & (counts[1] > 0) & (size >= 3)
        for part, count in zip((~own, own), counts, strict=True):
            weight, of = part.astype(float), np.maximum(count, 1)

            def mean(values, weight=weight, of=of):
                return sums(weight, values) / of

            m = [mean(x[:, j]) for j in range(p)]
            second = [mean(x[:, j] ** 2) for j in range(p)]
            v = [_positive(s - a * a, s) for a, s in zip(m, second, strict=True)]
            cov, quartic = {}, {}
            for j, k in pairs:
                both = mean(x[:, j] * x[:, k])
                cov[j, k] = both - m[j] * m[k]
                quartic[j, k] = mean((x[:, j] * x[:, k]) ** 2) - 2 * (m[k] * mean(x[:, j] ** 2 * x[:, k]) + m[j] * mean(x[:, j] * x[:, k] ** 2))
                quartic[j, k] += m[k] ** 2 * second[j] + m[j] ** 2 * second[k] + 4 * m[j] * m[k] * both - 3 * (m[j] * m[k]) ** 2
            if pairs:
                close = functools.reduce(np.logical_or, [(a > 0) & (a < 1e-3 * s) for a, s in zip(v, second, strict=True)])
                at = np.nonzero(close & fit[lo : lo + some])
                for i in range(0, len(at[0]), many := max(PROBLEMS // n, 1)):
                    of_perm, of_fold = at[0][i : i + many], at[1][i : i + many]
                    mine = part[of_perm] & trained[of_fold]
                    share = mine / mine.sum(1, keepdims=True)
                    z = [x[:, j] - share @ x[:, j, None] for j in range(p)]
                    for j in range(p):
                        v[j][of_perm, of_fold] = np.where(v[j][of_perm, of_fold] > 0, (share * z[j] ** 2).sum(1), 0)
                    for j, k in pairs:
                        cov[j, k][of_perm, of_fold] = (share * z[j] * z[k]).sum(1)
                        quartic[j, k][of_perm, of_fold] = (share * z[j] ** 2 * z[k] ** 2).sum(1)
            g = [1 / np.where(a > 0, a, 1.0) for a in v]
            noise, distance = np.zeros(count.shape), np.zeros(count.shape)
            for j, k in pairs:
                scale = 2 * g[j] * g[k]
                squares = scale * cov[j, k] ** 2
                distance += squares
                noise += scale * quartic[j, k] - squares
            apart = distance > 1e-12
            intensity = np.where(apart, np.clip(noise / of / np.where(apart, distance, 1), 0, 1), 1.0)
            made.append((m, v, cov, intensity))
        total = counts[0] + counts[1]
        shares = [np.broadcast_to(s, total.shape) for s in priors] if priors else [c / np.maximum(total, 1) for c in counts]
        whole = [[None] * p for _ in range(p)]
        floor = sum(s * intensity * functools.reduce(np.minimum, v) for s, (_, v, _, intensity) in zip(shares, made, strict=True))
        for j in range(p):
            whole[j][j] = sum(s * v[j] for s, (_, v, _, _) in zip(shares, made, strict=True))
        for j, k in pairs:
            whole[j][k] = sum(s * (1 - intensity) * cov[j, k] for s, (_, _, cov, intensity) in zip(shares, made, strict=True))
        apart = [b1 - b0 for b0, b1 in zip(made[0][0], made[1][0], strict=True)]
        solved = _eliminated(whole, apart)
        unsound = np.nonzero(~(floor > 1e-10 * functools.reduce(np.maximum, [whole[j][j] for j in range(p)])) & fit[lo : lo + some])
        if len(unsound[0]):
            rows = np.stack([np.stack([whole[min(j, k)][max(j, k)][unsound] for k in range(p)], -1) for j in range(p)], -2)
            right = np.stack([d[unsound] for d in apart], -1)
            least = np.matmul(np.linalg.pinv(rows, rcond=1e-11), right[:, :, None])[..., 0]
            for j in range(p):
                solved[j][unsound] = least[:, j]
        ratio = np.log(priors[1] / priors[0]) if priors else np.log(np.maximum(counts[1], 1) / np.maximum(counts[0], 1))
        intercept = ratio - sum(wj * ((m0 + m1) / 2 + cj) for wj, m0, m1, cj in zip(solved, made[0][0], made[1][0], center, strict=True))
        here = fit[lo : lo + some]
        b[lo : lo + some] = np.where(here, intercept, 0)
        for j in range(p):
            w[lo : lo + some, :, j] = np.where(here, solved[j], 0)
    return w, b, fit


def _eliminated(whole: list[list], right: list[np.ndarray]) -> list[np.ndarray]:
    """Solutions of positive definite systems, of which ``whole`` has the upper triangles' entries and ``right`` the right sides', all problems' in an array each."""
    p = len(right)
    whole, right = [list(row) for row in whole], list(right)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for i in range(p):
            for j in range(i + 1, p):
                f = whole[i][j] / whole[i][i]
                for k in range(j, p):
                    whole[j][k] = whole[j][k] - f * whole[i][k]
                right[j] = right[j] - f * right[i]
        for i in reversed(range(p)):
            right[i] = (right[i] - sum((whole[i][k] * right[k] for k in range(i + 1, p)), 0.0)) / whole[i][i]
    return right


def left_out_lda(x: np.ndarray, own: Moments, other: Moments, one: bool, priors: tuple[float, float] | None = None, target: str = "identity") -> np.ndarray:
    """Each row's log odds by the discriminant of all rows but it, from its class's moments less the row's own products; ``one``: whether the rows are of the positive class."""
    p = x.shape[1]
    both = Moments.added([own, other])
    var = np.diag(both.gram)[1 : p + 1] / both.gram[0, 0]
    sd = np.sqrt(np.where(var > 0, var, 1.0))
    own, other = (m.moved(both.center).scaled(sd) for m in (own, other))
    x, at = (x - both.center) / sd, np.arange(p)
    u = powers(x)

    def class_of(gram: np.ndarray, less: np.ndarray) -> tuple:
        n = gram[0, 0] - less[:, 0]
        y = less[:, 1 : p + 1]
        m = (gram[0, 1 : p + 1] - y) / n[:, None]
        second = (gram[1 : p + 1, 1 : p + 1] - y[:, :, None] * y[:, None]) / n[:, None, None]
        s = second - m[:, :, None] * m[:, None]
        v = s[:, at, at] = _positive(s[:, at, at], second[:, at, at])
        g = 1 / np.where(v > 0, v, 1.0)
        a = np.column_stack([(g * m * m).sum(1), -2 * g * m, g])
        norms = (((a @ gram) * a).sum(1) - (a * less).sum(1) ** 2) / n
        third = (gram[at + 1, at + p + 1] - y * less[:, p + 1 :]) / n[:, None]
        fourth = (gram[at + p + 1, at + p + 1] - less[:, p + 1 :] ** 2) / n[:, None]
        quartic = (g * g * (fourth - 4 * m * third + 6 * m * m * second[:, at, at] - 3 * m**4)).sum(1)
        return n, m, s, norms, quartic

    out = np.full(len(x), np.nan)
    if own.gram[0, 0] < 2 or own.gram[0, 0] + other.gram[0, 0] < 4:
        return out
    for lo in range(0, len(x), 256):
        part = u[lo : lo + 256]
        classes = [class_of(own.gram, part), class_of(other.gram, np.zeros_like(part))]
        w, b = _discriminants(classes if not one else classes[::-1], priors, target)
        out[lo : lo + 256] = (w * x[lo : lo + 256]).sum(1) + b
    return out


def stacked_lasso(grams: np.ndarray, xy: np.ndarray, n: np.ndarray, alpha: float, tol: float = 1e-4, most: int = 10_000) -> np.ndarray:
    """``lasso`` coefficients for each fold's centered products of features (``folds x p x p``) and all permutations' products with the target (``folds x p x permutations``).

    Folds whose products have an inverse are solved exactly, by signs (``_by_signs``), others, as those with fewer rows than features, along the path of
    penalties (``_by_path``); what neither ends on a minimum, by steps of coordinates.
    """
    w = np.full(xy.shape, np.nan)
    for fold, (gram, own) in enumerate(zip(grams, xy, strict=True)):
        inverse = _inverse(gram)
        if inverse is not None:
            w[fold] = _by_signs(inverse, own, alpha * n[fold])
        left = np.isnan(w[fold]).any(0)
        if left.any():
            w[fold][:, left] = _by_path(gram, own[:, left], alpha * n[fold])
            left = np.isnan(w[fold]).any(0)
        if left.any():
            w[fold][:, left] = _descended(grams[fold : fold + 1], xy[fold : fold + 1][:, :, left], n[fold : fold + 1], alpha, tol, most)[0]
    return w


def _inverse(gram: np.ndarray) -> np.ndarray | None:
    """The inverse, or none where rounding would tell in it."""
    try:
        inverse = np.linalg.inv(gram)
    except np.linalg.LinAlgError:
        return None
    condition = np.abs(gram).sum(0).max() * np.abs(inverse).sum(0).max()
    return inverse if condition < 1e9 else None


def _by_signs(inverse: np.ndarray, xy: np.ndarray, weight: float, most: int = 50) -> np.ndarray:
    """Coefficients (``p x problems``) of Lasso problems with one matrix of products.

    ``w = inverse (xy - weight s)`` with ``s`` the sign of each coefficient, or a number within -1 .. 1 where it is 0. Given which are 0 and
    the others' signs, at first those without penalty, ``s`` follows from a small linear system; coefficients that come out with the other sign are 0 next,
    and zeros whose ``s`` is beyond 1 get that sign, until nothing changes, which is the minimum. Problems that don't get there in ``most`` rounds have NaN.
    """
    back = inverse.T
    plain = xy.T @ back
    w, s, at = np.full(plain.shape, np.nan), np.sign(plain), np.arange(len(plain))
    for _ in range(most):
        zero, v = s == 0, plain - weight * (s @ back)
        k = zero.sum(1)
        if k.any():
            rows = np.argsort(~zero, axis=1, kind="stable")[:, : k.max()]
            held = np.arange(rows.shape[1]) < k[:, None]
            systems = np.where(held[:, :, None] & held[:, None], inverse[rows[:, :, None], rows[:, None]], np.eye(rows.shape[1]))
            free = np.linalg.solve(systems, np.where(held, np.take_along_axis(v, rows, 1), 0)[:, :, None])[..., 0]
            within = np.zeros(s.shape)
            within[np.nonzero(held)[0], rows[held]] = free[held]
            v = np.where(zero, 0, v - within @ back)
            new = np.where(zero, np.sign(within) * (np.abs(within) > weight), np.where(v * s < 0, 0, s))
        else:
            new = np.where(v * s < 0, 0, s)
        same = (new == s).all(1)
        w[at[same]] = v[same]
        if same.all():
            break
        s, plain, at = new[~same], plain[~same], at[~same]
    return w.T


def _by_path(gram: np.ndarray, xy: np.ndarray, weight: float) -> np.ndarray:
    """As ``_by_signs`` without an inverse: from the penalty that leaves nothing down to ``weight``, past each one at which a coefficient comes in or goes out.

    Between these, coefficients are linear in the penalty. What doesn't end on a minimum, as with equal features, is NaN.
    """
    p, m = xy.shape
    w, c, at = np.zeros((m, p)), xy.T.copy(), np.arange(m)
    high = np.abs(c).max(1)
    active, going, out = np.abs(c) >= high[:, None], high > weight, np.zeros((m, p))
    for _ in range(8 * p):
        w, c, active, high, at = (v[going] for v in (w, c, active, high, at))
        if not len(at):
            break
        each, s = np.arange(len(at)), np.where(active, np.sign(c), 0)
        k = active.sum(1)
        rows = np.argsort(~active, axis=1, kind="stable")[:, : k.max()]
        held = np.arange(rows.shape[1]) < k[:, None]
        systems = gram[rows[:, :, None], rows[:, None]]
        systems[~(held[:, :, None] & held[:, None])] = 0
        systems[:, np.arange(rows.shape[1]), np.arange(rows.shape[1])] += ~held
        try:
            found = np.linalg.solve(systems, np.where(held, np.take_along_axis(s, rows, 1), 0)[:, :, None])[..., 0]
        except np.linalg.LinAlgError:
            break
        d = np.zeros(w.shape)
        d[np.nonzero(held)[0], rows[held]] = found[held]
        a = d @ gram
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = np.where(active, -w / d, np.minimum(*(np.where(r > 1e-12, q / r, np.inf) for q, r in ((high[:, None] - c, 1 - a), (high[:, None] + c, 1 + a)))))
        steps[~(steps > 1e-12 * high[:, None])] = np.inf
        j = steps.argmin(1)
        step = np.minimum(steps[each, j], high - weight)
        w, c, high = w + step[:, None] * d, c - step[:, None] * a, high - step
        going = steps[each, j] < high + step - weight
        leaves = going & active[each, j]
        w[each[leaves], j[leaves]] = 0
        active[each[going], j[going]] ^= True
        out[at] = w
    rest = xy.T - out @ gram
    wrong = np.where(out != 0, np.abs(rest - weight * np.sign(out)), np.abs(rest) - weight).max(1) > 1e-6 * weight
    out[wrong] = np.nan
    return out.T


def _descended(grams: np.ndarray, xy: np.ndarray, n: np.ndarray, alpha: float, tol: float, most: int) -> np.ndarray:
    """As ``stacked_lasso``; a step moves one feature of all problems, and a problem that has converged stays."""
    w = np.zeros_like(xy)
    diag = np.diagonal(grams, axis1=1, axis2=2)
    active = np.ones((len(xy), xy.shape[2]), bool)
    for _ in range(most):
        largest = np.zeros(active.shape)
        for j in range(xy.shape[1]):
            d = diag[:, j, None]
            r = xy[:, j] - np.matmul(grams[:, j : j + 1], w)[:, 0] + d * w[:, j]
            new = np.where((d > 0) & active, np.sign(r) * np.maximum(np.abs(r) - alpha * n[:, None], 0) / np.where(d > 0, d, 1), w[:, j])
            largest = np.maximum(largest, np.abs(new - w[:, j]))
            w[:, j] = new
        active &= largest > tol * np.maximum(np.abs(w).max(1), 1e-300)
        if not active.any():
            break
    return w


def lasso(x: np.ndarray, y: np.ndarray, alpha: float, tol: float = 1e-4, most: int = 10_000) -> tuple[np.ndarray, float]:
    """``coefficients, intercept`` that minimise half the mean squared error plus alpha times the absolute coefficients."""
    mx, my = x.mean(0), y.mean()
    x, y = x - mx, y - my
    w = stacked_lasso((x.T @ x)[None], (x.T @ y)[None, :, None], np.array([len(y)]), alpha, tol, most)[0, :, 0]
    return w, float(my - mx @ w)


def ridge(x: np.ndarray, y: np.ndarray, k: float) -> tuple[np.ndarray, float]:
    """``coefficients, intercept`` in the scale of x, penalised on standardised features."""
    mx, sd, my = x.mean(0), x.std(0, ddof=1), y.mean()
    sd = np.where(sd == 0, 1, sd)
    z = (x - mx) / sd
    w = np.linalg.solve(z.T @ z + k * np.eye(z.shape[1]), z.T @ (y - my)) / sd
    return w, float(my - mx @ w)


def ridge_penalty(x: np.ndarray, y: np.ndarray, folds: int = 10) -> float:
    """Of 100 penalties, the smallest within one standard error of the least cross-validated error."""
    grid = np.logspace(-4, 5, 100)
    parts = np.array_split(np.arange(len(y)), min(folds, len(y)))
    errors = np.empty((len(grid), len(parts)))
    for j, test in enumerate(parts):
        train = np.setdiff1d(np.arange(len(y)), test)
        mx, sd, my = x[train].mean(0), x[train].std(0, ddof=1), y[train].mean()
        sd = np.where(sd == 0, 1, sd)
        z = (x[train] - mx) / sd
        values, vectors = np.linalg.eigh(z.T @ z)  # all penalties' systems have these axes
        w = vectors @ ((vectors.T @ (z.T @ (y[train] - my)))[:, None] / (np.maximum(values, 0)[:, None] + grid))
        errors[:, j] = np.sqrt(np.mean((y[test][:, None] - my - (x[test] - mx) / sd @ w) ** 2, axis=0))
    mean = errors.mean(1)
    best = mean.argmin()
    limit = mean[best] + errors[best].std(ddof=1) / np.sqrt(len(parts)) if len(parts) > 1 else mean[best]
    return float(grid[np.flatnonzero(mean <= limit)[0]])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[np.ndarray, float]:
    """``coefficients, intercept`` by iteratively reweighted least squares."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-10)
        step = np.linalg.lstsq((a * s[:, None]).T @ a, a.T @ (y - p), rcond=None)[0]
        w += step
        if np.abs(step).max() < 1e-8 or np.abs(w).max() > 1e6:
            break
    return w[1:], float(w[0])


def rbf_svm(x: np.ndarray, y: np.ndarray, box: float, scale: float, sweeps: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """``rows, weights, intercept`` of a kernel machine on standardised features, by pairwise coordinate ascent."""
    signs, n = np.where(y == 1, 1.0, -1.0), len(y)
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / scale**2)
    a, b, rng = np.zeros(n), 0.0, np.random.default_rng(seed)
    for _ in range(sweeps):
        moved = False
        for i in range(n):
            e = (a * signs) @ kernel[i] + b - signs[i]
            if not ((signs[i] * e < -1e-3 and a[i] < box) or (signs[i] * e > 1e-3 and a[i] > 0)):
                continue
            j = (i + rng.integers(1, n)) % n
            f = (a * signs) @ kernel[j] + b - signs[j]
            eta = kernel[i, i] + kernel[j, j] - 2 * kernel[i, j]
            same = signs[i] == signs[j]
            low, high = (max(0, a[i] + a[j] - box), min(box, a[i] + a[j])) if same else (max(0, a[j] - a[i]), min(box, box + a[j] - a[i]))
            if eta <= 0 or low >= high:
                continue
            new = float(np.clip(a[j] + signs[j] * (e - f) / eta, low, high))
            if abs(new - a[j]) < 1e-6:
                continue
            di, dj = -signs[i] * signs[j] * (new - a[j]), new - a[j]
            b1 = b - e - signs[i] * di * kernel[i, i] - signs[j] * dj * kernel[i, j]
            b2 = b - f - signs[i] * di * kernel[i, j] - signs[j] * dj * kernel[j, j]
            a[i], a[j] = a[i] + di, new
            b = b1 if 0 < a[i] < box else b2 if 0 < a[j] < box else (b1 + b2) / 2
            moved = True
        if not moved:
            break
    return x, a * signs, b


def kernel_machines(kernels: np.ndarray, y: np.ndarray, boxes: np.ndarray, tol: float = 1e-3, most: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """``weights, intercepts`` of one kernel machine for each kernel matrix and box, all solved at once.

    Each step moves every machine's two rows that break its optimality most, until none does by ``tol``.
    """
    signs, each = np.where(y == 1, 1.0, -1.0), np.arange(len(kernels))
    a = np.zeros((len(kernels), len(y)))
    error = np.tile(-signs, (len(kernels), 1))
    boxes = np.asarray(boxes, float)[:, None]
    for _ in range(most):
        full, empty = a >= boxes, a <= 0
        up = np.where(np.where(signs > 0, full, empty), np.inf, error)
        down = np.where(np.where(signs > 0, empty, full), -np.inf, error)
        i, j = up.argmin(1), down.argmax(1)
        gap = down[each, j] - up[each, i]
        if (gap < tol).all():
            break
        bend = kernels[each, i, i] + kernels[each, j, j] - 2 * kernels[each, i, j]
        room_i = np.where(signs[i] > 0, boxes[:, 0] - a[each, i], a[each, i])
        room_j = np.where(signs[j] > 0, a[each, j], boxes[:, 0] - a[each, j])
        move = np.where(gap < tol, 0, np.minimum(gap / np.maximum(bend, 1e-12), np.minimum(room_i, room_j)))
        a[each, i] += signs[i] * move
        a[each, j] -= signs[j] * move
        a = np.clip(a, 0, boxes)
        error += move[:, None] * (kernels[each, :, i] - kernels[each, :, j])
    full, empty = a >= boxes, a <= 0
    low = np.where(np.where(signs > 0, full, empty), np.inf, error).min(1)
    high = np.where(np.where(signs > 0, empty, full), -np.inf, error).max(1)
    return a * signs, -(low + high) / 2


def searched_machine(x: np.ndarray, y: np.ndarray, points: int = 30, folds: int = 3, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """``rows, weights, intercept, box, scale`` of the kernel machine with the least cross-validated error on standardised features.

    ``points`` boxes and scales are drawn from 0.001 to 1,000, evenly in their logarithms; the first of the best is taken.
    """
    boxes, scales = 10 ** np.random.default_rng(seed).uniform(-3, 3, (2, points))
    distance = ((x[:, None] - x[None]) ** 2).sum(-1)
    kernels = np.exp(-distance / scales[:, None, None] ** 2)
    wrong = np.zeros(points)
    for part in range(folds):
        test = np.arange(len(y)) % folds == part
        if len(np.unique(y[~test])) > 1:
            w, b = kernel_machines(kernels[:, ~test][:, :, ~test], y[~test], boxes)
            said = (kernels[:, test][:, :, ~test] @ w[:, :, None])[..., 0] + b[:, None] > 0
            wrong += (said != (y[test] == 1)).sum(1)
    best = int(wrong.argmin())
    w, b = kernel_machines(kernels[best : best + 1], y, boxes[best : best + 1])
    return x, w[0], float(b[0]), float(boxes[best]), float(scales[best])


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve, ties as half; NaN with one class."""
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    pos = y == 1
    n1, n0 = pos.sum(), (~pos).sum()
    return float((rank[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")


def areas(y: np.ndarray, score: np.ndarray) -> np.ndarray:
    """``auc`` of each row of ``y`` and ``score``, over those that have a score."""
    order = np.argsort(score, axis=1)
    score, known = np.take_along_axis(score, order, 1), ~np.isnan(score)
    pos = np.take_along_axis(y, order, 1) == 1
    pos &= (at := np.arange(score.shape[1])) < known.sum(1)[:, None]
    new = np.ones(score.shape, bool)
    new[:, 1:] = score[:, 1:] != score[:, :-1]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    end = np.ones(score.shape, bool)
    end[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(end, at, len(at))[:, ::-1], axis=1)[:, ::-1]
    n1 = pos.sum(1)
    n0 = known.sum(1) - n1
    both = (n1 > 0) & (n0 > 0)
    ranks = np.where(pos, (first + last) / 2 + 1, 0).sum(1)
    return np.where(both, (ranks - n1 * (n1 + 1) / 2) / np.where(both, n1 * n0, 1), np.nan)
