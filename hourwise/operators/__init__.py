"""DataFrame operators over (enriched) readings.

enrich     the derived calendar / band / spike columns (one projection)
summaries  exploration and hour / weekday patterns (partial + final hash aggregates)
trends     windows over daily and monthly aggregates
insights   hour-of-day and day-level business insights
windows    scalable global windows over raw readings (row number, NTILE, moving frames)
"""
