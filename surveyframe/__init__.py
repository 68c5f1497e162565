"""DataFrame-in, DataFrame-out operators for survey catalogues, time series and spectra."""
