"""Analytics over market data (trade tapes, order books, bars, labels, folds) as Spark jobs."""
