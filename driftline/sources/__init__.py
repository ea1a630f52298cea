"""Where rows come from and go to: catalogs, query items, result tables."""
