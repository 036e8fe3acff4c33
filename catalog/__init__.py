"""Every operator as a query on the shared tables, with equivalent SQL."""

from catalog import files, landings_views, relational, statistics, survey_views

ALL = {
    **files.QUERIES,
    **relational.QUERIES,
    **statistics.QUERIES,
    **survey_views.QUERIES,
    **landings_views.QUERIES,
}
