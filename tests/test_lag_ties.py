"""Two straight lines correlate alike at opposite lags but for rounding, so their means must not hang on the order of rows."""

from pairwave.operators import synchrony

# a trial of two lines of which one is nearly level; the SQL's delay is 1
A = (33.02385549991714, 33.02422805874321, 33.02460061756928, 33.02497317639535, 33.02534573522142, 33.02571829404749, 33.02609085287356,
     33.02646341169963, 33.0268359705257, 33.02720852935177, 33.02758108817784, 33.02795364700391, 33.028326205829984)
B = (101.41428725918492, 95.9446390483992, 90.47499083761349, 85.00534262682778, 79.53569441604206, 74.06604620525636, 68.59639799447064,
     63.126749783684936, 57.65710157289922, 52.18745336211351, 46.717805151327795, 41.24815694054209, 35.77850872975637)


def test_delay_of_lines_does_not_hang_on_the_order_of_rows(spark):
    rows = list(enumerate(zip(A, B)))
    n, dealt = len(rows), []
    for i in range(n):
        turned = rows[i:] + rows[:i]
        dealt += [(2 * i + back, k, a, b) for back, way in enumerate((turned, turned[::-1])) for k, (a, b) in way]
    df = spark.createDataFrame(dealt, "g long, k long, a double, b double").coalesce(1)
    best = synchrony.peak_lag(synchrony.cross_correlation(df, ["g"], "k", 10), ["g"], signed=True)
    assert {r.g: max(r.lag, 1) for r in best.collect()} == dict.fromkeys(range(2 * n), 1)
