"""Plan fragments several operators share: reports, exact quantiles, ranks, scratch folders."""
