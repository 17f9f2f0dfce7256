"""DataFrame -> DataFrame jobs. None of them collects, loops over rows or reads the clock."""
