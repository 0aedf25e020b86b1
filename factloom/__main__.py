from factloom.cli import main

raise SystemExit(main())
